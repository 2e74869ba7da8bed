"""Website-language analytics on Spark: from a landed crawl snapshot to language reports."""

from tonguemap.config import DEFAULT, EngineConfig

__all__ = ["DEFAULT", "EngineConfig"]
