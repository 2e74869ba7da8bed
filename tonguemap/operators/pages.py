"""One narrow projection per profile that turns page bodies into signals. No shuffle.

Steps that later expressions read more than once are separate columns, so the optimizer keeps
them as one evaluation; the body is gone before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import html, text, urls
from tonguemap.functions.once import once
from tonguemap.sources.crawl import error_line, fetch_ok


@once
def _web_links(hrefs: str, parts: str) -> Column:
    bound = F.transform(F.transform(hrefs, urls.web_reference), lambda h: urls.resolve(F.col(parts), h))
    absolute = F.array_compact(F.transform(F.filter(bound, lambda u: u.isNotNull()), urls.web_url))
    return F.transform(
        absolute,
        lambda u: F.struct(u.alias("url"), urls.hostname(u).alias("host"), F.lower(urls.path(u)).alias("path")),
    ).alias("web_links")


@once
def _site_signals() -> list[Column]:
    tags = F.col("tags")
    return [
        html.html_lang(tags).alias("html_lang"),
        html.link_tags(tags).alias("link_tags"),
        html.anchor_hrefs(tags).alias("hrefs"),
        F.coalesce(html.is_spa(F.col("body"), tags), F.lit(False)).alias("spa"),
    ]


def site_pages(crawl: DataFrame) -> DataFrame:
    """Site profile signals of every fetch; ``site`` is the host that was asked for.

    Evidence is read from whatever body came back, error pages included. ``web_links`` are the usable anchors
    in order, as ``array<struct<url, host, path>>``.
    """
    raw = crawl.withColumn("site", urls.hostname(F.col("requested_url"))).withColumn(
        "tags", html.page_tags(F.col("body"))
    )
    pages = raw.select("seq", "site", "requested_url", "status_code", "error", *_site_signals())
    with_parts = pages.withColumn("_parts", urls.base_parts(F.col("requested_url")))
    return with_parts.select(*pages.columns, _web_links("hrefs", "_parts"))


def alternate_codes(link_tags: Column) -> Column:
    """Codes of ``rel=alternate`` links with a language, ``x-default`` aside."""
    kept = F.filter(
        link_tags,
        lambda t: (F.lower(t["rel"]) == "alternate") & (t["hreflang"] != "") & (F.lower(t["hreflang"]) != "x-default"),
    )
    return F.transform(kept, lambda t: urls.site_code(t["hreflang"]))


def scored_fetches(crawl: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Fetches that count as pages: failed ones do, landed content that is not HTML does not.

    Adds canonical ``url``, registered ``domain``, ``page_url`` (where the fetch ended) and ``src``, the body
    if the fetch went well.
    """
    ok = fetch_ok() & (F.coalesce(F.col("body"), F.lit("")) != "")
    return (
        crawl.where(~ok | html.is_html(F.col("content_type"), F.col("body")))
        .withColumn("url", urls.normalize(F.col("requested_url")))
        .withColumn("domain", urls.domain_of(F.col("requested_url"), cfg.suffixes))
        .withColumn("page_url", F.coalesce(urls.none_if_empty(F.col("final_url")), F.col("url")))
        .withColumn("src", F.when(ok, F.col("body")))
    )


@once
def _scored_signals() -> list[Column]:
    tags = F.col("tags")
    return [
        urls.none_if_empty(urls.strip(html.html_lang(tags))).alias("html_lang"),
        F.filter(html.link_tags(tags), lambda t: F.lower(t["rel"]).contains("alternate")).alias("alternates"),
        html.anchor_hrefs(tags).alias("hrefs"),
    ]


@once
def _scored_targets(rules: tuple[str, ...]) -> list[Column]:
    def on_domain(links: Column) -> Column:
        return F.filter(urls.normalize_all(links, F.col("parts")), lambda u: urls.domain_of(u, rules) == F.col("domain"))

    values = F.transform("alternates", lambda t: urls.strip(t["hreflang"]))
    return [
        F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))).alias("hreflangs"),
        on_domain(F.array_compact(F.transform("alternates", lambda t: t["href"]))).alias("hreflang_urls"),
        on_domain(F.col("hrefs")).alias("internal_links"),
        urls.scored_code(F.col("html_lang")).alias("html_code"),
        urls.scored_url_code(F.col("page_url")).alias("url_code"),
        F.length("visible_text").cast("long").alias("visible_text_length"),
    ]


def scored_pages(crawl: DataFrame, cfg: EngineConfig = DEFAULT, keep_text: bool = False) -> DataFrame:
    """Scored profile signals of every page, without bodies; the text only on demand."""
    raw = (
        scored_fetches(crawl, cfg)
        .withColumn("tags", html.page_tags(F.col("src")))
        .withColumn("parts", urls.base_parts(F.col("page_url")))
        .withColumn("fetch_error", error_line("page"))
    )
    own = [
        "seq", "domain", "requested_url", "url", "final_url", "page_url", "status_code", "error", "fetch_error",
        "visible_text",
    ]
    signals = html.with_visible_text(raw, "src", "visible_text").select(*own, "parts", *_scored_signals())
    out = signals.select(*own, "html_lang", *_scored_targets(cfg.suffixes))
    out = text.with_text_language(out, "visible_text", "text_code", cfg=cfg)
    return out if keep_text else out.drop("visible_text")
