"""robots.txt and sitemap documents as tables."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonguemap import dims
from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import urls
from tonguemap.functions.html import decode_xml

# fixed values: patterns
_LOC = r"(?s)<(?:[\w.\-]+:)?loc(?:\s[^>]*)?>\s*(<!\[CDATA\[.*?\]\]>|[^<]*)"
_ROOT = r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.\-]+:)?([\w.\-]+)"


def sitemap_lines(body: Column) -> Column:
    """Values of the ``sitemap:`` lines of a robots file, in order, first of equals kept."""
    lines = F.transform(F.split(body, r"\r\n|\r|\n"), urls.strip)
    named = F.filter(lines, lambda x: F.lower(x).startswith("sitemap:"))
    values = F.transform(named, lambda x: urls.strip(F.substr(x, F.lit(9))))
    return F.array_distinct(F.filter(values, lambda v: v != ""))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(domain, pos, sitemap) of robots documents (domain, body)."""
    return robots.select("domain", F.posexplode(sitemap_lines(F.col("body"))).alias("pos", "sitemap"))


def filter_domain_urls(links: Column, domain: Column, parts: Column, rules: tuple[str, ...] = ()) -> Column:
    """Canonical URLs of an array that stay on the registered domain, first of equals kept."""
    return F.filter(urls.normalize_all(links, parts), lambda u: urls.domain_of(u, rules) == domain)


def usable_body(fetches: DataFrame) -> Column:
    """Body of a fetch that went well, NULL otherwise; a table without ``status_code`` holds no error pages."""
    status = F.coalesce(F.col("status_code").between(200, 399), F.lit(False)) if "status_code" in fetches.columns else F.lit(True)
    return F.when(F.col("error").isNull() & status, F.col("body"))


def robots_url(url: Column) -> Column:
    """Where the robots file of a URL's host is."""
    return F.concat(F.regexp_extract(url, "^https?://[^/?#]*", 0), F.lit("/robots.txt"))


def with_robots(starts: DataFrame, robots: DataFrame) -> DataFrame:
    """Start URLs (domain, url) with what came of their robots file: robots_url, body and error.

    ``robots`` is a fetch table; of several fetches of a file one that went well counts.
    """
    landed = robots.select(F.col("requested_url").alias("robots_url"), F.struct("error", usable_body(robots).alias("body")).alias("f"))
    first = landed.groupBy("robots_url").agg(F.min("f").alias("f"))
    given = starts.select("domain", "url").withColumn("robots_url", robots_url(F.col("url")))
    return given.join(first, "robots_url", "left").select("domain", "url", "robots_url", "f.body", "f.error")


def sitemap_candidates(starts: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """(domain, start, pos, url) of start URLs (domain, url, body of their robots file or NULL).

    The listed sitemaps, then the default places of the host, also where there is no robots file; on the domain
    only. Works inside each row: no join and no shuffle. Listed values must be absolute, others drop out.
    """
    origin = F.regexp_extract("url", "^https?://[^/?#]*", 0)
    listed = F.filter(
        F.coalesce(sitemap_lines(F.col("body")), F.array().cast("array<string>")),
        lambda u: u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"),
    )
    defaults = F.array(*[F.concat(origin, F.lit(p)) for p in dims.DEFAULT_SITEMAP_PATHS])
    with_parts = starts.select("domain", F.col("url").alias("start"), F.concat(listed, defaults).alias("all"), urls.base_parts(origin).alias("parts"))
    kept = filter_domain_urls(F.col("all"), F.col("domain"), F.col("parts"), cfg.suffixes)
    return with_parts.select("domain", "start", F.posexplode(kept).alias("pos", "url"))


@F.pandas_udf(T.BinaryType())
def _inflate(payloads: pd.Series) -> pd.Series:
    """Unpacked payloads; None where one is broken."""

    def unpacked(payload: bytes | None) -> bytes | None:
        try:
            return None if payload is None else gzip.decompress(payload)
        except (OSError, EOFError, zlib.error):
            return None

    return payloads.map(unpacked)


def payload_text(docs: DataFrame, payload: str, out: str = "body") -> DataFrame:
    """Add the text of landed bytes: packed ones (they begin with 1f8b) are unpacked, and what is no UTF-8 is replaced.

    A packed payload that is cut off or broken gives NULL. Only packed rows go to Python, in Arrow batches.
    """
    text = lambda c: F.make_valid_utf8(c.cast("string"))
    packed = F.substring(payload, 1, 2) == F.lit(b"\x1f\x8b")
    plain = docs.where(~F.coalesce(packed, F.lit(False))).withColumn(out, text(F.col(payload)))
    return plain.unionByName(docs.where(packed).withColumn(out, text(_inflate(payload))))


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """Add ``parse_error``, ``is_index`` and ``locs`` to sitemap documents with a column ``body``.

    A malformed document gets ``ParseError`` and no locs; the job goes on. Empty ones give nothing.
    """
    xml = docs.withColumn("_xml", urls.strip(F.col("body")))
    checked = F.from_xml(
        F.col("_xml"), "_x STRING, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    plain = F.regexp_replace("_xml", "(?s)<!--.*?-->", "")
    raw = F.regexp_extract_all(plain, F.lit(_LOC), F.lit(1))
    bare = F.transform(
        raw,
        lambda v: F.when(v.startswith("<![CDATA["), F.regexp_replace(v, r"^<!\[CDATA\[|\]\]>$", "")).otherwise(
            decode_xml(v)
        ),
    )
    locs = F.array_distinct(F.filter(F.transform(bare, urls.strip), lambda v: v != ""))
    bad = (F.col("_xml") != "") & F.col("_checked._bad").isNotNull()
    return (
        xml.withColumn("_checked", checked)
        .withColumn("parse_error", F.when(bad, F.lit("ParseError")))
        .withColumn("is_index", F.lower(F.regexp_extract("_xml", _ROOT, 1)).endswith("sitemapindex"))
        .withColumn("locs", F.when(F.coalesce(~bad, F.lit(False)), locs).otherwise(F.array().cast("array<string>")))
        .drop("_xml", "_checked")
    )
