"""What a crawl knows of its domains before it reads pages, as one run over landed tables.

Start URLs of a domain list, the robots files of their hosts, the sitemap trees below, the page URLs that those
list, and what failed on the way. Its tables are long and keyed by registered domain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import urls
from tonguemap.operators.graph import listed_urls, sitemap_expand
from tonguemap.operators.skew import keep_first
from tonguemap.operators.stage import stage, together
from tonguemap.sources import crawl, sitemaps


@dataclass(frozen=True)
class Discovery:
    starts: DataFrame  # (domain, url)
    sitemaps: DataFrame  # (domain, rank, url, new_urls) that were read
    urls: DataFrame  # (domain, url) of start URLs and sitemaps, distinct
    errors: DataFrame  # (domain, kind, url, error)

    def only(self, cond: Column) -> Discovery:
        """What was found for some of the domains."""
        return Discovery(*(df.where(cond) for df in (self.starts, self.sitemaps, self.urls, self.errors)))


def start_urls(domains: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Distinct (domain, url): start URLs of a domain list (column ``domain``) by registered domain."""
    usable = crawl.seeds(domains.select("domain").distinct(), "domain", cfg).where(F.col("error").isNull())
    return usable.select(F.col("registered_domain").alias("domain"), F.col("normalized_url").alias("url")).distinct()


def sitemap_tables(fetches: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children (parent, pos, url) of indexes, page URLs (sitemap, url), and failures (url, kind, error), from a
    fetch table of sitemap documents (requested_url, body, error). Of several fetches one that went well counts."""
    landed = fetches.select(F.col("requested_url").alias("url"), sitemaps.usable_body(fetches).alias("body"), "error")
    docs = keep_first(landed, ["url"], ["error", "body"]).withColumn("domain", urls.domain_of(F.col("url"), cfg.suffixes))
    parsed = sitemaps.parse_sitemaps(docs).withColumn("parts", urls.base_parts(F.col("url")))
    kept = sitemaps.filter_domain_urls(F.col("locs"), F.col("domain"), F.col("parts"), cfg.suffixes)
    read = stage(parsed.select("url", "error", "parse_error", "is_index", kept.alias("kept")), "sitemap-documents")
    found = read.select(F.col("url").alias("doc"), "is_index", F.posexplode("kept").alias("pos", "url"))
    children = found.where("is_index").select(F.col("doc").alias("parent"), "pos", "url")
    locs = found.where(~F.col("is_index")).select(F.col("doc").alias("sitemap"), "url")
    kind = F.when(F.col("error").isNotNull(), "sitemap").otherwise("sitemap_parse")
    failed = read.select("url", kind.alias("kind"), F.coalesce("error", "parse_error").alias("error"))
    return children, locs, failed.where(F.col("error").isNotNull())


def discover(starts: DataFrame, robots: DataFrame, fetches: DataFrame, cfg: EngineConfig = DEFAULT) -> Discovery:
    """Run discovery for start URLs (domain, url) over the robots and sitemap fetches that landed.

    Both fetch tables have requested_url, body and error, and may have a status_code. A file that never landed is no failure, it just gives nothing.
    """
    begun, (children, locs, failed) = together(
        lambda: stage(sitemaps.with_robots(starts, robots), "starts"), lambda: sitemap_tables(fetches, cfg))
    roots = sitemaps.sitemap_candidates(begun, cfg).select("domain", "pos", "url")
    read = stage(sitemap_expand(roots, children, locs, begun, cfg), "sitemaps")
    known = listed_urls(read, locs, cfg).select("domain", "url").unionByName(begun.select("domain", "url")).distinct()
    no_robots = begun.where(F.col("error").isNotNull()).select("domain", F.lit("robots").alias("kind"), F.col("robots_url").alias("url"), "error")
    errors = read.select("domain", "url").join(failed, "url").select("domain", "kind", "url", "error").unionByName(no_robots)
    return Discovery(begun.select("domain", "url"), read, known, errors)


def fetch_errors(discovery: Discovery | None, pages: DataFrame) -> DataFrame:
    """(domain, kind, url, error, line): all failures of a run; ``pages`` are those of the scored profile."""
    failed = pages.where(F.col("error").isNotNull()).select("domain", F.lit("page").alias("kind"), F.col("url"), "error")
    if discovery is not None:
        failed = failed.unionByName(discovery.errors)
    return failed.withColumn("line", F.concat_ws(": ", "kind", "url", "error"))
