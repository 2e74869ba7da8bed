"""Scored profile: weighted points per (domain, code), thresholded findings, warnings, reports.

``pages`` below is the output of :func:`tonguemap.operators.pages.scored_pages`, best staged: it holds
links and codes but no bodies. All tables are long and keyed by domain, so no domain can influence
another and none needs to fit in one row. ``seq`` is the crawl order of the pages.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import render, urls
from tonguemap.operators.skew import top_k
from tonguemap.operators.stage import stage

if TYPE_CHECKING:
    from tonguemap.operators.discovery import Discovery


def page_targets() -> Column:
    """URLs a page names: all hreflang targets, then its internal links."""
    return F.concat("hreflang_urls", "internal_links")


def crawl_targets(cfg: EngineConfig = DEFAULT) -> Column:
    """URLs a page adds to the crawl: all hreflang targets, then its first internal links."""
    return F.concat("hreflang_urls", F.slice("internal_links", 1, cfg.max_links_per_page))


def discovered_urls(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct (domain, url, code): page targets, and ``known`` (domain, url), as of start URLs and sitemaps.

    The distinct is keyed by the URL too, so a hot domain spreads over all tasks.
    """
    found = pages.select("domain", F.explode(page_targets()).alias("url"))
    if known is not None:
        found = found.unionByName(known.select("domain", "url"))
    return found.distinct().withColumn("code", urls.scored_url_code(F.col("url")))


def candidate_paths(discovered: DataFrame) -> DataFrame:
    """Distinct (domain, path) of language folders at the root of discovered URLs."""
    p = discovered.select("domain", urls.candidate_path(F.col("url")).alias("path"))
    return p.where(F.col("path").isNotNull()).distinct()


def _marks() -> Column:
    """Trusted (code, source, evidence) marks of a page; each distinct hreflang value once."""
    def mark(code: Column, source: str, evidence: Column) -> Column:
        return F.struct(code.alias("code"), F.lit(source).alias("source"), evidence.alias("evidence"))

    marks = F.concat(
        F.array(
            mark(F.col("html_code"), "html_lang", F.concat(F.lit("html_lang="), "html_lang")),
            mark(F.col("url_code"), "url_pattern", F.lit("url_or_subdomain_pattern")),
        ),
        F.transform(
            F.coalesce("hreflangs", F.array().cast("array<string>")),
            lambda h: mark(urls.scored_code(h), "hreflang", F.concat(F.lit("hreflang="), h)),
        ),
    )
    return F.filter(marks, lambda m: m["code"].isNotNull())


def page_marks(pages: DataFrame) -> DataFrame:
    """Marks of the pages, pre-aggregated to (domain, code, source, evidence): their number and the first page with one."""
    each = pages.select("domain", "seq", F.explode(_marks()).alias("m"))
    return each.groupBy("domain", "m.code", "m.source", "m.evidence").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def trusted_evidence(pages: DataFrame, discovered: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Trusted points pre-aggregated to (domain, code, source, evidence)."""
    return trusted_points(page_marks(pages), discovered, cfg)


def trusted_points(marks: DataFrame, discovered: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Trusted points of the marks of pages and of discovered URLs.

    ``n`` counts the single pieces of evidence and ``first_seq`` is the first page that gave one; 0 means
    before any page. Each distinct hreflang value counts once for the domain and once more per page.
    """
    # the domain-level set holds each of these values once more, ahead of all pages
    is_hreflang = F.col("source") == "hreflang"
    per_page = marks.select(
        "domain", "code", "source", "evidence", (F.col("n") + is_hreflang.cast("long")).alias("n"),
        F.when(is_hreflang, F.lit(0).cast("long")).otherwise(F.col("first_seq")).alias("first_seq"),
    )
    by_url = (
        discovered.where(F.col("code").isNotNull())
        .groupBy("domain", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("evidence", F.lit("url_or_subdomain_pattern"))
    )
    by_path = (
        candidate_paths(discovered)
        .withColumn("code", urls.scored_code(F.regexp_extract("path", "^/([^/-]*)", 1)))
        .where(F.col("code").isNotNull())
        .select("domain", "code", F.lit(1).cast("long").alias("n"), F.col("path").alias("evidence"))
    )
    before_pages = by_url.unionByName(by_path).withColumn("source", F.lit("url_pattern"))
    before_pages = before_pages.withColumn("first_seq", F.lit(0).cast("long"))
    points = F.create_map(*[F.lit(x) for kv in cfg.points.items() for x in kv])
    return (
        per_page.unionByName(before_pages)
        .groupBy("domain", "code", "source", "evidence")
        .agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
        .withColumn("points", F.col("n") * F.element_at(points, F.col("source")))
    )


def _conflict() -> Column:
    """Does the text of a page say another language than its markup and its URL?"""
    text = F.col("text_code")
    return ~text.eqNullSafe(F.col("html_code")) & ~text.eqNullSafe(F.col("url_code"))


def supplemental_gate(pages: DataFrame, trusted: DataFrame) -> DataFrame:
    """Pages with a text language, and whether its code was trusted by the time of the page."""
    texts = pages.where(F.col("text_code").isNotNull()).select(
        "domain", "seq", "page_url", F.col("text_code").alias("code"), _conflict().alias("conflict"))
    return gated_texts(texts, trusted)


def gated_texts(texts: DataFrame, trusted: DataFrame) -> DataFrame:
    """``texts`` (domain, seq, page_url, code, conflict) with ``counts``: was the code trusted by then?"""
    first = trusted.groupBy("domain", "code").agg(F.min("first_seq").alias("first_seq"))
    # one row per domain and code on the right, so Spark may split a hot domain on the left
    joined = texts.join(first, ["domain", "code"], "left")
    return joined.withColumn("counts", F.coalesce(F.col("first_seq") <= F.col("seq"), F.lit(False))).drop("first_seq")


_FACT = ["domain", "kind", "code", "source", "evidence", "url", "at", "conflict"]


def page_facts(pages: DataFrame) -> DataFrame:
    """What the report needs of the pages, in one pass: marks, URLs they name, texts that speak, and the domain itself.

    Facts of several batches merge by :func:`merged_facts`, in any order.
    """
    given = {"code": "string", "source": "string", "evidence": "string", "url": "string", "at": "long", "conflict": "boolean"}

    def fact(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in given.items()])

    none = F.array().cast("array<string>")
    spoken = F.when(
        F.col("text_code").isNotNull(), F.array(fact("text", code=F.col("text_code"), url=F.col("page_url"), at=F.col("seq"), conflict=_conflict())))
    facts = F.concat(
        F.array(fact("page")),
        F.transform(_marks(), lambda m: fact("mark", code=m["code"], source=m["source"], evidence=m["evidence"])),
        F.transform(F.coalesce(page_targets(), none), lambda u: fact("url", url=u)),
        F.coalesce(spoken, F.array().cast(f"array<struct<kind: string, {', '.join(f'{c}: {t}' for c, t in given.items())}>>")),
    )
    each = pages.select("domain", "seq", F.explode(facts).alias("f")).select("domain", "seq", "f.*")
    return each.groupBy(*_FACT).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def merged_facts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*_FACT).agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"), F.max("batch").alias("batch"))


def report_of_facts(facts: DataFrame, known: Discovery | None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Report of merged facts, and of the URLs known ahead of all pages."""
    facts = stage(facts, "scored-facts")
    kind = lambda k: facts.where(F.col("kind") == k)
    found = kind("url").select("domain", "url")
    domains = kind("page").select("domain")
    if known is not None:
        found, domains = found.unionByName(known.urls), domains.unionByName(known.starts.select("domain"))
    discovered = found.distinct().withColumn("code", urls.scored_url_code(F.col("url")))
    trusted = stage(trusted_points(kind("mark"), discovered, cfg), "trusted")
    gate = gated_texts(kind("text").select("domain", F.col("at").alias("seq"), F.col("url").alias("page_url"), "code", "conflict"), trusted)
    scores = language_scores(evidence_points(trusted, gate, cfg))
    return language_report(language_findings(scores, cfg), warnings(gate), domains.distinct())


def evidence_points(trusted: DataFrame, gate: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Trusted points plus those of text that agrees with trusted evidence."""
    text = (
        gate.where("counts")
        .groupBy("domain", "code")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "domain", "code", F.lit("text_heuristic").alias("source"), F.lit("text_heuristic").alias("evidence"), "n",
            (F.col("n") * cfg.points["text_heuristic"]).alias("points"),
        )
    )
    return trusted.drop("first_seq").unionByName(text)


def language_scores(points: DataFrame) -> DataFrame:
    """Raw score, shown percent and label per (domain, code)."""
    return (
        points.groupBy("domain", "code")
        .agg(F.sum("points").alias("score"))
        .withColumn("confidence_percent", render.confidence_percent(F.col("score")))
        .withColumn("confidence_label", render.confidence_label(F.col("confidence_percent")))
        .withColumn("name", render.scored_language_name(F.col("code")))
    )


def language_findings(scores: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return scores.where(F.col("confidence_percent") >= cfg.confidence_threshold)


def finding_sources(points: DataFrame, scores: DataFrame) -> DataFrame:
    """Sorted distinct sources per (domain, code), with the two confidence entries.

    The set is small by construction: a code has a bounded number of spellings (case, region) and of
    ``/xx-yy/`` folders. It is distinct before it is collected.
    """
    said = points.select("domain", "code", "evidence").distinct()
    sets = said.groupBy("domain", "code").agg(F.collect_list("evidence").alias("said"))
    extra = F.array(
        F.concat(F.lit("confidence="), F.col("confidence_percent").cast("string"), F.lit("%")),
        F.concat(F.lit("confidence_label="), F.col("confidence_label")),
    )
    return scores.join(sets, ["domain", "code"]).select(
        "domain", "code", F.array_sort(F.array_union("said", extra)).alias("sources")
    )


def finding_urls(pages: DataFrame, discovered: DataFrame, gate: DataFrame) -> DataFrame:
    """Distinct (domain, code, url) that may serve as a sample."""
    of_page = F.array_distinct(
        F.array_compact(
            F.concat(F.array("html_code", "url_code"), F.transform("hreflangs", urls.scored_code))
        )
    )
    none = F.array().cast("array<string>")
    by_page = pages.select("domain", F.explode(F.coalesce(of_page, F.array_compact(F.array("html_code", "url_code")), none)).alias("code"), F.col("page_url").alias("url"))
    by_text = gate.where("counts").select("domain", "code", F.col("page_url").alias("url"))
    by_url = discovered.where(F.col("code").isNotNull()).select("domain", "code", "url")
    return by_page.unionByName(by_text).unionByName(by_url).distinct()


def finding_sample_urls(candidates: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The five smallest URLs per (domain, code), ranked."""
    return top_k(candidates, ["domain", "code"], [F.col("url")], cfg.sample_urls)


def warnings(gate: DataFrame) -> DataFrame:
    """Warning rows; one page can give both kinds."""
    def kind(name: str, message: str) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(message).alias("message"))

    kinds = F.array_compact(
        F.array(
            F.when(F.col("conflict"), kind("text_signal_conflict", dims.CONFLICT_MESSAGE)),
            F.when(~F.col("counts"), kind("suppressed_text_only_language", dims.SUPPRESSED_MESSAGE)),
        )
    )
    return gate.select("domain", "seq", "code", "page_url", F.explode(kinds).alias("k")).select(
        "domain", "seq", F.col("k.type").alias("type"), render.scored_language_name(F.col("code")).alias("language"),
        "code", F.col("page_url").alias("url"), F.col("k.message").alias("message"),
    )


def discovery_counts(
    pages: DataFrame, discovered: DataFrame, errors: DataFrame, sitemaps: DataFrame | None = None
) -> DataFrame:
    """Seven counts per domain: distinct values, and numbers of pages and of failures of any kind."""
    none = F.array().cast("array<string>")
    items = pages.select(
        "domain",
        F.explode(F.transform(F.coalesce("hreflangs", none), lambda v: F.struct(F.lit("hreflang_targets").alias("kind"), v.alias("value")))).alias("i"),
    ).select("domain", "i.kind", "i.value")
    hosts = discovered.select("domain", F.lit("subdomains").alias("kind"), urls.host(F.col("url")).alias("value"))
    paths = candidate_paths(discovered).select(
        "domain", F.lit("candidate_language_paths").alias("kind"), F.col("path").alias("value")
    )
    distinct = items.unionByName(hosts).distinct().unionByName(paths).select("domain", "kind")
    plain = discovered.select("domain", F.lit("urls").alias("kind"))
    plain = plain.unionByName(pages.select("domain", F.lit("pages").alias("kind")))
    plain = plain.unionByName(errors.select("domain", F.lit("fetch_errors").alias("kind")))
    if sitemaps is not None:
        plain = plain.unionByName(sitemaps.select("domain", F.lit("sitemaps").alias("kind")))
    kinds = [
        "subdomains", "sitemaps", "urls", "hreflang_targets", "candidate_language_paths", "pages", "fetch_errors",
    ]
    return distinct.unionByName(plain).groupBy("domain").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def language_report(findings: DataFrame, warning_rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Report row per domain: ordered languages and number of warnings.

    A domain has at most one finding per known code, so the collected list is bounded; warnings stay rows.
    """
    label = render.language_label(F.col("name"), F.col("confidence_label"), F.col("confidence_percent"))
    ordered = F.struct((-F.col("confidence_percent")).alias("o"), F.col("name"), label.alias("label"))
    found = findings.groupBy("domain").agg(F.array_sort(F.collect_list(ordered)).alias("f"))
    warned = warning_rows.groupBy("domain").agg(F.count(F.lit(1)).alias("w"))
    return (
        domains.select("domain")
        .join(found, "domain", "left")
        .join(warned, "domain", "left")
        .select(
            "domain",
            F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("language_count"),
            F.coalesce(F.transform("f", lambda x: x["label"]), F.array().cast("array<string>")).alias("languages"),
            F.coalesce("w", F.lit(0)).cast("long").alias("warning_count"),
        )
    )


def summary(report: DataFrame) -> DataFrame:
    """Four-column summary; a domain with warnings or without languages needs review."""
    return report.select(
        F.col("domain").alias("domain_name"),
        F.col("language_count").cast("string").alias("language_count"),
        F.array_join("languages", "; ").alias("languages"),
        render.yes_no((F.col("warning_count") > 0) | (F.col("language_count") == 0)).alias("review_recommended"),
    )


def summary_bridge(report: DataFrame) -> DataFrame:
    """Summary of the service bridge: only a domain without languages needs review."""
    return report.select(
        F.col("domain").alias("domain_name"),
        F.col("language_count").cast("string").alias("language_count"),
        F.array_join("languages", "; ").alias("languages"),
        render.yes_no(F.col("language_count") == 0).alias("review_recommended"),
    )


def report_documents(
    findings: DataFrame, sources: DataFrame, samples: DataFrame, warning_rows: DataFrame, counts: DataFrame
) -> DataFrame:
    """Nested report per domain, fields in alphabetical order as the published JSON has them.

    Lists are bounded by the known codes and the sample size. A domain can have a warning for each of its
    pages, so the report has their number, and :func:`warnings` is a table of its own.
    """
    urls_of = samples.groupBy("domain", "code").agg(F.array_sort(F.collect_list("url")).alias("sample_urls"))
    detail = findings.join(sources, ["domain", "code"]).join(urls_of, ["domain", "code"], "left")
    none = F.array().cast("array<string>")
    finding = F.struct(
        "code", "confidence_label", "confidence_percent", "name",
        F.coalesce("sample_urls", none).alias("sample_urls"), "sources",
    )
    found = detail.groupBy("domain").agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("confidence_percent")).alias("o"), F.col("name").alias("n"), finding.alias("f")))
        ).alias("f")
    )
    warned = warning_rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_warnings"))
    kinds = sorted(c for c in counts.columns if c != "domain")
    joined = counts.join(found, "domain", "left").join(warned, "domain", "left")
    findings_col = F.transform("f", lambda x: x["f"])
    labels = F.transform(
        "f",
        lambda x: render.language_label(x["f"]["name"], x["f"]["confidence_label"], x["f"]["confidence_percent"]),
    )
    out = joined.select(
        F.struct(*kinds).alias("discovery_counts"),
        "domain",
        findings_col.alias("findings"),
        F.coalesce(F.size("f"), F.lit(0)).cast("long").alias("language_count"),
        F.coalesce(labels, none).alias("languages"),
        F.coalesce("n_warnings", F.lit(0)).cast("long").alias("warning_count"),
    )
    # an empty list, not NULL: the document always shows the key
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(out.schema["findings"].dataType)))
