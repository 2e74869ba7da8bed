"""Reports for a list of domains: a row for each of them, also where nothing landed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import render
from tonguemap.sources.crawl import seeds


def site_report_listed(domains: DataFrame, report: DataFrame) -> DataFrame:
    """Site report keyed by the listed ``domain``, by way of the host of its start URL.

    A site of which no page landed has no status of its own and counts as 500; a person should look.
    """
    start = seeds(domains.select("domain").distinct(), "domain").select("domain", "host")
    joined = start.join(report.withColumnRenamed("domain", "host"), "host", "left")
    return joined.select(
        "domain", F.coalesce("status", render.status_text(F.lit(500))).alias("status"),
        F.coalesce("language_count", F.lit(0).cast("long")).alias("language_count"),
        F.coalesce("languages", F.lit("-")).alias("languages"),
        F.coalesce("review_recommended", F.lit("Yes")).alias("review_recommended"),
    )


def language_report_listed(domains: DataFrame, report: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Scored report keyed by the listed ``domain``, by way of its registered domain."""
    start = seeds(domains.select("domain").distinct(), "domain", cfg).select("domain", "registered_domain")
    joined = start.join(report.withColumnRenamed("domain", "registered_domain"), "registered_domain", "left")
    n, warned = (F.coalesce(c, F.lit(0).cast("long")) for c in ("language_count", "warning_count"))
    return joined.select(
        "domain", "registered_domain", n.alias("language_count"),
        F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), warned.alias("warning_count"),
        render.yes_no((warned > 0) | (n == 0)).alias("review_recommended"),
    )
