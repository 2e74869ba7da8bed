"""Site profile: unweighted language evidence per site, status, probing and the site report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import render, urls
from tonguemap.functions.once import once
from tonguemap.operators.pages import alternate_codes


def _marks(codes: Column, strategy: str) -> Column:
    return F.transform(codes, lambda c: F.struct(c.alias("code"), F.lit(strategy).alias("strategy")))


@once
def page_marks() -> Column:
    """All (code, strategy) marks of a page as one array, so the bodies are read once."""
    own = F.filter("web_links", lambda link: link["host"].contains(F.col("site")))
    none = F.array().cast("array<string>")

    def each(one: callable) -> Column:
        return F.array_compact(F.transform(own, one))

    return F.concat(
        _marks(F.when(F.col("html_lang") != "", F.array(urls.site_code(F.col("html_lang")))).otherwise(none), "html_lang"),
        _marks(F.coalesce(alternate_codes(F.col("link_tags")), none), "hreflang"),
        _marks(F.coalesce(each(lambda link: urls.site_path_code(link["path"])), none), "link_path"),
        _marks(F.coalesce(F.flatten(F.transform(own, lambda link: urls.site_name_codes(link["path"]))), none), "link_name"),
        _marks(F.coalesce(each(lambda link: urls.site_subdomain_code(link["host"])), none), "link_subdomain"),
    )


def site_facts(pages: DataFrame) -> DataFrame:
    """Everything the report needs, pre-aggregated to (site, code, strategy) in one pass over the pages.

    A mark without code stands for the page itself, so sites without evidence keep their status.
    """
    answered = F.when(F.col("status_code").isNotNull(), F.col("seq"))
    read = F.when(F.col("spa").isNotNull(), F.col("seq"))
    itself = F.struct(F.lit(None).cast("string").alias("code"), F.lit("page").alias("strategy"))
    flags = pages.select(
        "site", "seq", "status_code",
        F.col("error").isNotNull().alias("failed"),
        F.coalesce(F.size(alternate_codes(F.col("link_tags"))) > 0, F.lit(False)).alias("hl"),
        "spa",
        F.explode(F.concat(F.array(itself), page_marks())).alias("m"),
    )
    return flags.groupBy("site", F.col("m.code").alias("code"), F.col("m.strategy").alias("strategy")).agg(
        F.count(F.lit(1)).alias("marks"),
        F.bool_or("failed").alias("has_error"),
        F.bool_or("hl").alias("has_hreflang"),
        # the value at the smallest seq, and that seq, each a plain number that a hash aggregate can hold
        F.min_by("status_code", answered).alias("first_status"),
        F.min(answered).alias("status_seq"),
        F.min_by("spa", read).alias("first_spa"),
        F.min(read).alias("spa_seq"),
    )


def merged_facts(facts: DataFrame) -> DataFrame:
    """Facts of several batches as those of one."""
    return facts.groupBy("site", "code", "strategy").agg(
        F.sum("marks").alias("marks"), F.bool_or("has_error").alias("has_error"), F.bool_or("has_hreflang").alias("has_hreflang"),
        F.min_by("first_status", "status_seq").alias("first_status"), F.min("status_seq").alias("status_seq"),
        F.min_by("first_spa", "spa_seq").alias("first_spa"), F.min("spa_seq").alias("spa_seq"), F.max("batch").alias("batch"))


def by_registered_domain(pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pages of the site profile with the registered domain as their site, in place of the host that was asked for."""
    return pages.withColumn("site", urls.registered_domain(F.col("site"), cfg.suffixes))


def visited_pages(pages: DataFrame, visits: DataFrame) -> DataFrame:
    """The pages of a crawl as those of its domain: ``visits`` (domain, rank, url), in the order of the visits.

    ``pages`` are those of the site profile; of several fetches of a URL the first counts.
    """
    first = pages.groupBy(F.col("requested_url").alias("url")).agg(F.min("seq").alias("seq"))
    ranked = visits.select("domain", "rank", "url").join(first, "url").select("domain", "rank", "seq")
    return pages.join(ranked, "seq").withColumn("site", F.col("domain")).withColumn("seq", F.col("rank").cast("long")).drop("domain", "rank")


def site_evidence(facts: DataFrame) -> DataFrame:
    """Distinct (site, code, strategy) with the number of marks behind it."""
    return facts.where(F.col("strategy") != "page").select("site", "code", "strategy", "marks")


def _status_aggregates() -> list[Column]:
    return [
        F.coalesce(F.bool_or("has_error"), F.lit(False)).alias("has_error"),
        F.coalesce(F.bool_or("has_hreflang"), F.lit(False)).alias("has_hreflang"),
        F.min_by("first_status", "status_seq").alias("first_status"),
        F.coalesce(F.min_by("first_spa", "spa_seq"), F.lit(False)).alias("spa"),
    ]


def _status() -> Column:
    answered = render.status_text(F.coalesce(F.col("first_status"), F.lit(200)))
    return F.when(F.col("has_error"), F.lit("Error")).otherwise(answered)


def site_status(facts: DataFrame) -> DataFrame:
    """Per site: any error, first answered status, hreflang present, built in the browser (first page)."""
    pages = F.sum(F.when(F.col("strategy") == "page", F.col("marks")).otherwise(0)).alias("pages")
    return facts.groupBy("site").agg(*_status_aggregates(), pages).withColumn("status", _status())


def site_report(facts: DataFrame) -> DataFrame:
    """Report row per site: one aggregate over the few facts of the site."""
    name = F.when(F.length("code") >= 2, render.site_language_name(F.col("code")))
    per_site = facts.groupBy("site").agg(F.array_sort(F.collect_set(name)).alias("names"), *_status_aggregates())
    n = F.size("names").cast("long")
    return per_site.select(
        F.col("site").alias("domain"),
        _status().alias("status"),
        n.alias("language_count"),
        F.when(n == 0, "-").otherwise(F.array_join("names", "; ")).alias("languages"),
        render.yes_no((n == 0) | F.col("has_error") | (F.col("spa") & (n <= 1))).alias("review_recommended"),
    )


def with_probe_hits(facts: DataFrame, hits: DataFrame) -> DataFrame:
    """Facts with the codes that probing found added."""
    return facts.unionByName(hits.withColumn("strategy", F.lit("probe")), allowMissingColumns=True)


def probe_paths() -> list[tuple[str, str]]:
    """(path, code) worth asking for on a site that shows no other language than English."""
    return [
        (f"/{word}{end}", code)
        for name, code in dims.SITE_NAME_TO_CODE.items()
        if code != "en"
        for word in (code, name)
        for end in ("", "/")
    ]


def probe_gate(facts: DataFrame) -> DataFrame:
    """Sites with neither a language other than English nor an hreflang link."""
    other = F.coalesce(F.bool_or(F.col("code") != "en"), F.lit(False))
    seen = facts.groupBy("site").agg((other | F.bool_or("has_hreflang")).alias("seen"))
    return seen.where(~F.col("seen")).select("site")


def probe_candidates(sites: DataFrame) -> DataFrame:
    """The URLs to ask for: a fixed list per site, made by exploding a literal."""
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("code")) for p, c in probe_paths()])
    return sites.select("site", F.explode(paths).alias("p")).select(
        "site", "p.code", "p.path", F.concat(F.lit("https://"), F.col("site"), F.col("p.path")).alias("url")
    )


def probe_hits(candidates: DataFrame, fetches: DataFrame) -> DataFrame:
    """Distinct (site, code) whose candidate URL answered with 2xx or 3xx in the fetch log."""
    asked = sorted({path for path, _ in probe_paths()})
    url = F.col("requested_url")
    # few logged URLs are at such a path, which the scan can tell
    worth = F.col("status_code").between(200, 399) & F.regexp_extract(url, "^https://[^/]+(.*)$", 1).isin(asked)
    good = fetches.where(worth).select(url.alias("url")).distinct()
    return candidates.join(good, "url", "left_semi").select("site", "code").distinct()


def batch_validation(jobs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Verdict per job on its number of domains; ``jobs`` is (job_id, domain), domain NULL when none came."""
    n = F.count("domain")
    return jobs.groupBy("job_id").agg(
        n.alias("n_domains"),
        F.when(n == 0, "At least one domain is required.")
        .when(n > cfg.max_domains_per_job, f"Maximum {cfg.max_domains_per_job} domains per request.")
        .otherwise("ok")
        .alias("verdict"),
    )
