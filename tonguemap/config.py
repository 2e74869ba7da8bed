"""Every limit, weight and threshold of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class EngineConfig:
    # fixed values: budgets, weights and thresholds that decide results
    # scored profile: crawl budgets
    max_sitemaps: int = 50
    max_sitemap_urls: int = 5000
    max_pages: int = 100
    max_depth: int = 2
    max_links_per_page: int = 100
    # scored profile: detection
    min_text_chars: int = 300
    max_text_tokens: int | None = None  # whole texts; 500 for the published heuristic
    min_stop_word_hits: int = 4
    confidence_threshold: int = 40
    points: dict = field(
        default_factory=lambda: {
            "hreflang": 45, "html_lang": 35, "url_pattern": 35, "text_heuristic": 10,
        }
    )
    # site profile
    site_max_pages: int = 5
    site_queue_cap: int = 20
    max_domains_per_job: int = 50
    # public-suffix rules (``co.uk``, ``*.ck``, ``!www.ck``); without any, a domain is the last two labels
    suffixes: tuple[str, ...] = ()
    # keyed state
    quota_limit: int = 200
    quota_window: str = "1 hour"
    state_ttl: str = "1 hour"
    # reports
    sample_urls: int = 5
    debug_urls: int = 50
    debug_pages: int = 25
    # physical tuning: rows of a reference table that may be broadcast
    max_broadcast_rows: int = 200_000


DEFAULT = EngineConfig()
