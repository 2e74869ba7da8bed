"""Queries of the site profile and of single signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.functions import html, render, urls
from tonguemap.operators import graph, site
from tonguemap.operators.listed import site_report_listed as site_reports_listed
from tonguemap.operators.pages import site_pages
from tonguemap.operators.stage import stage
from tonguemap.plans import inputs
from tonguemap.plans.inputs import derive
from tonguemap.plans.registry import query
from tonguemap.sinks import reports as sinks
from tonguemap.sources import domains


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return site_pages(derive(spark, sf, inputs.CRAWL))


def facts(spark: SparkSession, sf: str) -> DataFrame:
    return site.site_facts(pages(spark, sf))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """One row per usable anchor."""
    return pages(spark, sf).select("seq", "site", F.posexplode("web_links").alias("pos", "l")).select(
        "seq", "site", F.col("pos").cast("long").alias("pos"), "l.*"
    )


@query
def site_report(spark: SparkSession, sf: str) -> DataFrame:
    return site.site_report(facts(spark, sf))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """The domain list: what the lines name, and for each host one that was never fetched."""
    lines = derive(spark, sf, inputs.DOMAIN_LINES).select("seq", "value")
    unknown = pages(spark, sf).select("seq", F.concat(F.lit("new-"), "site").alias("value"))
    return domains.domains_from_lines(lines, unknown).select("domain")


@query
def site_report_listed(spark: SparkSession, sf: str) -> DataFrame:
    return site_reports_listed(listed(spark, sf), site_report(spark, sf))


@query
def site_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return site.site_evidence(facts(spark, sf))


@query
def site_status(spark: SparkSession, sf: str) -> DataFrame:
    return site.site_status(facts(spark, sf)).select("site", "status", "has_error", "has_hreflang", "spa", "pages")


@query
def spa_flags(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).groupBy("site").agg(
        F.min_by("spa", "seq").alias("spa"), F.count_if("spa").alias("spa_pages")
    )


@query
def html_lang_site(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("html_lang")
    return pages(spark, sf).select("seq", lang, F.when(lang != "", urls.site_code(lang)).alias("code"))


@query
def hreflang_extract(spark: SparkSession, sf: str) -> DataFrame:
    tags = pages(spark, sf).select("seq", F.posexplode("link_tags").alias("pos", "t"))
    h = F.col("t.hreflang")
    exact = (F.lower("t.rel") == "alternate") & (h != "") & (F.lower(h) != "x-default")
    return tags.select(
        "seq", F.col("pos").cast("long").alias("pos"), F.col("t.rel").alias("rel"), h.alias("hreflang"),
        F.when(exact, urls.site_code(h)).alias("site_code"),
        F.when(F.lower("t.rel").contains("alternate"), urls.scored_code(h)).alias("scored_code"),
    )


@query
def link_path_codes(spark: SparkSession, sf: str) -> DataFrame:
    own = _links(spark, sf).where(F.col("host").contains(F.col("site")))
    return own.select("seq", "pos", urls.site_path_code(F.col("path")).alias("code")).where("code IS NOT NULL")


@query
def link_name_codes(spark: SparkSession, sf: str) -> DataFrame:
    own = _links(spark, sf).where(F.col("host").contains(F.col("site")))
    return own.select("seq", "pos", F.explode(urls.site_name_codes(F.col("path"))).alias("code"))


@query
def link_subdomain_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("seq", "pos", "host", urls.site_subdomain_code(F.col("host")).alias("code")).where(
        "code IS NOT NULL"
    )


@query
def host_contains_domain(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).groupBy("site", "host").agg(
        F.count(F.lit(1)).alias("links"), F.bool_or(F.col("host").contains(F.col("site"))).alias("own")
    )


@query
def frontier_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).where(urls.site_frontier(F.col("path"), F.col("host"))).select("seq", "pos", "url")


@query
def site_domain_clean(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive(spark, sf, inputs.DOMAIN_LINES)
    return lines.select("seq", urls.clean_site_domain(F.col("value")).alias("domain"))


@query
def language_names(spark: SparkSession, sf: str) -> DataFrame:
    codes = site.site_evidence(facts(spark, sf)).groupBy("code").agg(F.countDistinct("site").alias("sites"))
    return codes.select(
        "code", "sites", render.site_language_name(F.col("code")).alias("site_name"),
        render.scored_language_name(F.col("code")).alias("scored_name"),
    )


@query
def normalize_code(spark: SparkSession, sf: str) -> DataFrame:
    """Every link word and language attribute of the crawl as a language tag."""
    p = pages(spark, sf)
    words = F.transform("hrefs", lambda h: F.regexp_replace(h, "^/", ""))
    tags = F.concat(words, F.transform("link_tags", lambda t: t["hreflang"]), F.array("html_lang"))
    each = p.select(F.explode(F.array_compact(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return each.select(
        "tag", "n", urls.scored_code(F.col("tag")).alias("scored_code"), urls.site_code(F.col("tag")).alias("site_code")
    )


@query
def status_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = derive(spark, sf, inputs.STATUS_VALUES)
    return rows.select("seq", "status", render.status_text(F.col("status")).alias("status_text"))


@query
def probe_gate(spark: SparkSession, sf: str) -> DataFrame:
    return site.probe_gate(_raw_facts(spark, sf))


@query
def probe_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return site.probe_candidates(site.probe_gate(_raw_facts(spark, sf)))


@query
def probe_hits(spark: SparkSession, sf: str) -> DataFrame:
    gated = site.probe_candidates(site.probe_gate(_raw_facts(spark, sf)))
    return site.probe_hits(gated, derive(spark, sf, inputs.PROBE_LOG))


@query
def site_report_probed(spark: SparkSession, sf: str) -> DataFrame:
    f = stage(_raw_facts(spark, sf), "site-facts")
    hits = site.probe_hits(site.probe_candidates(site.probe_gate(f)), derive(spark, sf, inputs.PROBE_LOG))
    return site.site_report(site.with_probe_hits(f, hits))


def _raw_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the pages as given, which have no hreflang links, so that some sites pass the gate."""
    raw = inputs.table(spark, sf, "pages").selectExpr("page_id", f"{inputs.URL} AS url", "html").select(
        F.col("page_id").alias("seq"), F.col("url").alias("requested_url"), F.lit(200).alias("status_code"),
        F.col("html").alias("body"), F.lit(None).cast("string").alias("error"),
    )
    return site.site_facts(site_pages(raw))


@query
def batch_validation(spark: SparkSession, sf: str) -> DataFrame:
    return site.batch_validation(derive(spark, sf, inputs.JOBS))


@query
def http_fallback(spark: SparkSession, sf: str) -> DataFrame:
    fetches = derive(spark, sf, inputs.START_FETCHES)
    hosts = fetches.select(F.regexp_extract("requested_url", "//([^/]+)", 1).alias("domain")).distinct()
    out = graph.http_fallback(hosts, fetches)
    return out.withColumn("status_code", F.col("status_code").cast("long"))


def _visits(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of each registered domain over the given link graph."""
    edges = derive(spark, sf, inputs.EDGES).unionByName(derive(spark, sf, inputs.START_EDGES))
    link = F.struct("pos", F.col("dst").alias("url"), urls.hostname(F.col("dst")).alias("host"))
    worth = edges.where(urls.site_frontier(F.lower(urls.path(F.col("dst"))), urls.hostname(F.col("dst"))))
    # a page has four links here; on a crawl the array is the link list of one page
    targets = worth.groupBy(F.col("src").alias("url")).agg(F.array_sort(F.collect_list(link)).alias("t"))
    targets = targets.select("url", F.transform("t", lambda x: F.struct(x["url"], x["host"])).alias("targets"))
    starts = derive(spark, sf, inputs.ROBOTS).select("domain", F.concat(F.lit("https://"), "domain").alias("url"))
    return graph.bfs_site(starts, targets)


@query
def bfs_site(spark: SparkSession, sf: str) -> DataFrame:
    return _visits(spark, sf)


@query
def site_report_crawled(spark: SparkSession, sf: str) -> DataFrame:
    """The site report of each registered domain over the pages that its crawl visits, the first of them first."""
    visits = stage(_visits(spark, sf), "site-visits")
    return site.site_report(site.site_facts(site.visited_pages(stage(pages(spark, sf), "site-pages"), visits)))


@query
def site_report_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    """The site report with a row for each registered domain."""
    return site.site_report(site.site_facts(site.by_registered_domain(pages(spark, sf), inputs.CFG)))


@query
def frontier_links(spark: SparkSession, sf: str) -> DataFrame:
    """What a crawl would follow from each landed page, in the order of the page."""
    found = graph.frontier_links(pages(spark, sf)).select("url", F.posexplode("targets").alias("pos", "t"))
    return found.select("url", F.col("pos").cast("long").alias("pos"), F.col("t.url").alias("target"))


@query
def site_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.site_csv(site_report(spark, sf))


@query
def csv_escape(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents")
    return sinks.csv_lines(docs.select("doc_id", "source", "text"), ["doc_id", "source", "text"]).select("doc_id", "line")


@query
def html_escape(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.table(spark, sf, "documents")
    return docs.select("doc_id", render.html_escape(F.col("text")).alias("escaped"))


@query
def domain_slug(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.table(spark, sf, "pages").select("page_id", render.domain_slug(F.col("url")).alias("slug"))


@query
def batch_manifest(spark: SparkSession, sf: str) -> DataFrame:
    names = derive(spark, sf, inputs.CRAWL).select(urls.hostname(F.col("requested_url")).alias("domain"))
    return sinks.batch_manifest(names)


@query
def batch_manifest_totals(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.manifest_totals(batch_manifest(spark, sf))
