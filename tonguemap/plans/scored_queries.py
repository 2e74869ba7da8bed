"""Queries of the scored profile, its reports, and single scored signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.functions import html, text, urls
from tonguemap.operators import graph, scored
from tonguemap.operators.discovery import Discovery, discover, fetch_errors, start_urls
from tonguemap.operators.listed import language_report_listed as language_reports_listed
from tonguemap.operators.pages import scored_fetches, scored_pages, site_pages
from tonguemap.operators.run import ScoredRun
from tonguemap.operators.stage import new_path, stage
from tonguemap.plans import inputs
from tonguemap.plans.inputs import derive
from tonguemap.plans.registry import query
from tonguemap.sinks import reports as sinks
from tonguemap.sources.domains import domains_from_lines

COUNTS = ["subdomains", "sitemaps", "urls", "hreflang_targets", "candidate_language_paths", "pages", "fetch_errors"]


def pages(spark: SparkSession, sf: str, keep_text: bool = False) -> DataFrame:
    return scored_pages(derive(spark, sf, inputs.CRAWL), inputs.CFG, keep_text)


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """Start URLs: of the domain list, and of each registered domain."""
    roots = derive(spark, sf, inputs.ROBOTS).select(F.lit(0).cast("long").alias("seq"), F.col("domain").alias("value"))
    lines = derive(spark, sf, inputs.DOMAIN_LINES).select("seq", "value")
    return start_urls(domains_from_lines(lines, roots), inputs.CFG)


def discovered(spark: SparkSession, sf: str) -> Discovery:
    robots, sitemaps = derive(spark, sf, inputs.ROBOTS_FETCHES), derive(spark, sf, inputs.SITEMAP_FETCHES)
    return discover(starts(spark, sf), robots, sitemaps, inputs.CFG)


def run(spark: SparkSession, sf: str) -> ScoredRun:
    return ScoredRun(pages(spark, sf), lambda: discovered(spark, sf), inputs.CFG)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Nested reports."""
    return run(spark, sf).documents()


@query
def language_report(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).report.withColumn("languages", F.array_join("languages", "; "))


@query
def language_report_listed(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.plans.site_queries import listed

    out = language_reports_listed(listed(spark, sf), run(spark, sf).report, inputs.CFG)
    return out.withColumn("languages", F.array_join("languages", "; "))


@query
def evidence_points(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).points


@query
def language_scores(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).scores


@query
def language_findings(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).findings


@query
def supplemental_gate(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).gate


@query
def warnings(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).warnings


@query
def text_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).gate.where("conflict").select("domain", "seq", "code")


@query
def finding_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = run(spark, sf)
    return scored.finding_sources(s.points, s.scores).withColumn("sources", F.array_join("sources", "; "))


@query
def finding_sample_urls(spark: SparkSession, sf: str) -> DataFrame:
    s = run(spark, sf)
    out = scored.finding_sample_urls(scored.finding_urls(s.pages, s.discovered, s.gate))
    return out.select("domain", "code", "url", F.col("rank").cast("long").alias("rank"))


@query
def discovery_counts(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf).counts


@query
def discovery_csv(spark: SparkSession, sf: str) -> DataFrame:
    s = run(spark, sf)
    return sinks.discovery_csv(s.counts, scored.candidate_paths(s.discovered))


@query
def hreflang_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct hreflang values per domain, which the discovery CSV has the number of."""
    return sinks.hreflang_targets(pages(spark, sf))


@query
def fetch_error_log(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of robots files, sitemaps, their markup and pages."""
    return fetch_errors(discovered(spark, sf), pages(spark, sf))


@query
def record_urls(spark: SparkSession, sf: str) -> DataFrame:
    found = scored.discovered_urls(pages(spark, sf), discovered(spark, sf).urls)
    return found.select("domain", "url", urls.host(F.col("url")).alias("host"), "code")


@query
def candidate_paths(spark: SparkSession, sf: str) -> DataFrame:
    return scored.candidate_paths(scored.discovered_urls(pages(spark, sf), discovered(spark, sf).urls))


@query
def summary_v1(spark: SparkSession, sf: str) -> DataFrame:
    return scored.summary(run(spark, sf).report)


@query
def summary_bridge(spark: SparkSession, sf: str) -> DataFrame:
    return scored.summary_bridge(run(spark, sf).report)


@query
def summary_json_shape(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.summary_json(summary_v1(spark, sf))


@query
def summary_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.summary_markdown(summary_v1(spark, sf)).select("line")


@query
def language_report_csv(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.language_csv(documents(spark, sf))


@query
def report_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Reports written as JSON, read back and flattened to one row per finding."""
    from tonguemap.sources.reports import read_reports

    path = new_path(spark, "reports-json")
    sinks.write_json(documents(spark, sf), path)
    back = read_reports(spark, path)
    counts = [F.col("discovery_counts")[c].cast("long").alias(c) for c in COUNTS]
    f = back.select("domain", *counts, F.col("warning_count").alias("warnings"), F.explode("findings").alias("f"))
    return f.select(
        "domain", "warnings", "f.code", "f.name", "f.confidence_percent", "f.confidence_label", *COUNTS,
        F.array_join("f.sources", "; ").alias("sources"), F.array_join("f.sample_urls", "; ").alias("sample_urls"),
    )


@query
def debug_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    p = stage(pages(spark, sf), "scored-pages")
    return sinks.debug_snapshot(scored.discovered_urls(p, discovered(spark, sf).urls), p)


@query
def debug_payload(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.debug_payload(run(spark, sf))


@query
def page_evidence_no_text(spark: SparkSession, sf: str) -> DataFrame:
    p = sinks.pages_without_text(pages(spark, sf, keep_text=True))
    return p.select(
        "seq", "domain", "url", "final_url", F.col("status_code").cast("long").alias("status_code"), "html_lang",
        F.array_join("hreflangs", ";").alias("hreflang_targets"),
        F.array_join(F.array_sort("internal_links"), ";").alias("internal_links"), "visible_text_length", "error",
    )


@query
def isolation_check(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of two halves of the domains on their own against the whole batch: rows that differ, none."""
    batch = run(spark, sf)
    half = F.xxhash64("domain") < 0
    alone = [ScoredRun(batch.pages.where(c), batch.discovery.only(c), inputs.CFG).findings for c in (half, ~half)]
    alone = alone[0].unionByName(alone[1])
    both = batch.findings.withColumn("side", F.lit(1)).unionByName(alone.withColumn("side", F.lit(-1)))
    keys = [c for c in both.columns if c != "side"]
    differ = both.groupBy(*keys).agg(F.sum("side").alias("d"), F.count(F.lit(1)).alias("n"))
    return differ.agg(
        F.count_if(F.col("d") != 0).alias("differing"), F.coalesce(F.sum("n"), F.lit(0)).alias("compared")
    )


@query
def html_lang_scored(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("seq", "html_lang", F.col("html_code").alias("code"))


@query
def html_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = derive(spark, sf, inputs.CRAWL)
    return c.select("seq", F.coalesce(html.is_html(F.col("content_type"), F.col("body")), F.lit(False)).alias("html"))


@query
def hreflang_urls(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("seq", F.posexplode("hreflang_urls").alias("pos", "url")).select(
        "seq", F.col("pos").cast("long").alias("pos"), "url"
    )


@query
def internal_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("seq", F.posexplode("internal_links").alias("pos", "url")).select(
        "seq", F.col("pos").cast("long").alias("pos"), "url"
    )


@query
def link_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Targets per page with a cap that binds: all hreflang targets and the first three links."""
    from dataclasses import replace

    cfg = replace(inputs.CFG, max_links_per_page=3)
    return graph.page_links(pages(spark, sf), cfg).select("src", F.col("pos").cast("long").alias("pos"), "dst")


@query
def same_registered_domain(spark: SparkSession, sf: str) -> DataFrame:
    p = site_pages(derive(spark, sf, inputs.CRAWL))
    links = p.select(urls.registered_domain(F.col("site"), inputs.SUFFIXES).alias("domain"), F.explode("web_links.url").alias("url"))
    links = links.withColumn("target", urls.domain_of(F.col("url"), inputs.SUFFIXES))
    return links.groupBy("domain", "target").agg(
        F.count(F.lit(1)).alias("links"), F.bool_or(F.col("domain") == F.col("target")).alias("same")
    )


@query
def normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    p = site_pages(derive(spark, sf, inputs.CRAWL))
    each = p.select("seq", F.posexplode(F.concat(F.array("requested_url"), F.coalesce("hrefs", F.array().cast("array<string>")))).alias("pos", "raw"))
    return each.select(
        "seq", F.col("pos").cast("long").alias("pos"), "raw", urls.normalize(F.col("raw")).alias("url"),
        urls.normalize(F.col("raw"), keep_query=True).alias("url_with_query"),
    )


@query
def resolve_links(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors seen from their page: canonical form and browser form."""
    p = site_pages(derive(spark, sf, inputs.CRAWL)).withColumn("parts", urls.base_parts(F.col("requested_url")))
    each = p.select("seq", "parts", F.posexplode("hrefs").alias("pos", "href"))
    full = each.withColumn("full", urls.resolve(F.col("parts"), urls.web_reference(F.col("href"))))
    return full.select(
        "seq", F.col("pos").cast("long").alias("pos"), "href",
        urls.normalize(F.col("href"), F.col("parts")).alias("canonical"), urls.web_url(F.col("full")).alias("web"),
    )


@query
def url_language(spark: SparkSession, sf: str) -> DataFrame:
    p = pages(spark, sf).select(F.explode(F.concat(F.array("page_url"), F.coalesce("internal_links", F.array().cast("array<string>")))).alias("url"))
    return p.groupBy("url").agg(F.count(F.lit(1)).alias("n")).withColumn("code", urls.scored_url_code(F.col("url")))


@query
def visible_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf, keep_text=True).select("seq", "visible_text")


@query
def text_language_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("seq", "html_code", "url_code", "text_code")


@query
def text_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return text.with_text_language(docs, "text", "detected").select("doc_id", "lang", "detected")


@query
def stopword_hits(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents").select("doc_id", "text")
    hits = text.with_text_language(docs, "text", "detected", hits="hits")
    return hits.select("doc_id", *[F.col(f"hits.{c}").cast("long").alias(f"hits_{c}") for c in dims.STOP_WORDS])


@query
def crawl_seeds(spark: SparkSession, sf: str) -> DataFrame:
    known = discovered(spark, sf)
    return graph.crawl_seeds(known.starts, known.urls).select("domain", "url", F.col("pos").cast("long").alias("pos"))


def _visits(spark: SparkSession, sf: str, known: Discovery, pages_: DataFrame) -> DataFrame:
    edges = derive(spark, sf, inputs.EDGES)
    # each URL is on several edges, as their source and as their target
    distinct = edges.select(F.explode(F.array("src", "dst")).alias("raw")).distinct()
    clean = stage(distinct.select("raw", urls.normalize(F.col("raw")).alias("url")), "edge-urls")
    ends = edges.join(clean.toDF("src", "from"), "src").join(clean.toDF("dst", "to"), "dst")
    links = ends.select(F.col("from").alias("src"), "pos", F.col("to").alias("dst"))
    return graph.bfs_scored(graph.crawl_seeds(known.starts, known.urls), links, pages_, inputs.CFG)


@query
def bfs_scored(spark: SparkSession, sf: str) -> DataFrame:
    landed = scored_fetches(derive(spark, sf, inputs.CRAWL), inputs.CFG).select("url")
    out = _visits(spark, sf, discovered(spark, sf), landed)
    return out.select("domain", "url", F.col("depth").cast("long").alias("depth"), "rank")


@query
def language_report_crawled(spark: SparkSession, sf: str) -> DataFrame:
    """The report over the pages that a crawl within its budgets visits, in the order of the visits."""
    whole = run(spark, sf)
    visits = stage(_visits(spark, sf, whole.discovery, whole.pages.select("url")), "visits")
    return whole.visited(visits).report.withColumn("languages", F.array_join("languages", "; "))
