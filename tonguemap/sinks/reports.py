"""Published forms of the results: CSV, JSON, Markdown, per-domain debug files.

Text forms come as DataFrames of lines or flat columns, so they can be checked before they are written;
the ``write_*`` functions only add the format. Spark writes one file per task; nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import render, urls
from tonguemap.operators import scored
from tonguemap.operators.run import ScoredRun
from tonguemap.operators.skew import top_k

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "emptyValue": ""}


def language_csv(documents: DataFrame) -> DataFrame:
    """Five flat columns per report; findings as JSON text with sorted keys, warnings as their number.

    The warnings themselves, of which a domain can have one per page, are rows of their own files.
    """
    return documents.select(
        "domain", "language_count", F.array_join("languages", ";").alias("languages"),
        F.to_json("findings").alias("confidence_details"), F.col("warning_count").cast("string").alias("warnings"),
    )


def discovery_csv(counts: DataFrame, paths: DataFrame) -> DataFrame:
    """Seven flat columns per domain. Folders ``/xx-yy/`` are few and joined to text; hreflang values, which page
    authors may invent without end, are given as their number, and are rows of :func:`hreflang_targets`."""
    listed = paths.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("path")), ";").alias("path_text"))
    return counts.join(listed, "domain", "left").select(
        "domain", F.col("domain").alias("registered_domain"), F.col("subdomains").alias("subdomain_count"),
        F.col("urls").alias("url_count"), F.col("sitemaps").alias("sitemap_count"),
        F.coalesce("path_text", F.lit("")).alias("candidate_language_paths"), "hreflang_targets",
    )


def hreflang_targets(pages: DataFrame) -> DataFrame:
    """Distinct (domain, hreflang) of the pages."""
    return pages.select("domain", F.explode("hreflangs").alias("hreflang")).distinct()


def pages_without_text(pages: DataFrame) -> DataFrame:
    """Page evidence for publication: the text is replaced by its length."""
    return pages.drop("visible_text")


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("domain_name").alias("domain"),
        F.coalesce(F.nullif("language_count", F.lit("")).cast("int"), F.lit(0)).alias("languageCount"),
        "languages",
        F.col("review_recommended").alias("reviewRecommended"),
    )


# fixed values: opening lines of the Markdown summary
MARKDOWN_HEAD = [
    "## Portfolio summary",
    "",
    "| Domain Name | Language Count | Languages | Review Recommended |",
    "|---|---:|---|---|",
]


def summary_markdown(summary: DataFrame) -> DataFrame:
    """(domain_name, line) table rows; :data:`MARKDOWN_HEAD` goes in front."""
    line = render.markdown_row(
        F.col("domain_name"), F.col("language_count"), F.col("languages"), F.col("review_recommended")
    )
    return summary.select("domain_name", line.alias("line"))


def site_csv(report: DataFrame) -> DataFrame:
    """(domain, line) rows of the site CSV: status and languages always quoted, inner quotes doubled."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("-"))
    line = F.concat_ws(
        ",", F.col("domain"), render.csv_quote(status), F.col("language_count").cast("string"),
        render.csv_quote(F.col("languages")), F.col("review_recommended"),
    )
    return report.select("domain", line.alias("line"))


def csv_lines(df: DataFrame, columns: list[str], out: str = "line") -> DataFrame:
    """Add one CSV line per row, values quoted only where they need it."""
    return df.withColumn(out, F.concat_ws(",", *[render.csv_escape(F.col(c)) for c in columns]))


def debug_snapshot(discovered: DataFrame, pages: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Audit rows per domain: its first 50 URLs in order and its first 25 pages, as (kind, position, value)."""
    found = top_k(discovered.select("domain", "url"), ["domain"], [F.col("url")], cfg.debug_urls)
    seen = top_k(pages.select("domain", "seq", "page_url"), ["domain"], [F.col("seq")], cfg.debug_pages)
    return found.select(
        "domain", F.lit("discovered_url").alias("kind"), F.col("rank").cast("long").alias("position"), F.col("url").alias("value")
    ).unionByName(
        seen.select("domain", F.lit("page").alias("kind"), F.col("rank").cast("long").alias("position"), F.col("page_url").alias("value"))
    )


def debug_payload(run: ScoredRun) -> DataFrame:
    """All that explains a report, as (domain, kind, position, value) rows: the snapshot, findings in their order, warnings by
    page, counts by name, and the trusted evidence. Findings and warnings are JSON with sorted keys."""
    def rows(df: DataFrame, kind: str, value: Column, position: Column | None = None) -> DataFrame:
        at = F.lit(None) if position is None else position
        return df.select("domain", F.lit(kind).alias("kind"), at.cast("long").alias("position"), value.alias("value"))

    ordered = top_k(run.findings, ["domain"], [F.desc("confidence_percent"), F.col("name")], len(dims.SCORED_CODES))
    finding = F.to_json(F.struct("code", "confidence_label", "confidence_percent", "name"))
    warning = F.to_json(F.struct("code", "language", "message", "type", "url"))
    counts = run.counts.unpivot("domain", [c for c in run.counts.columns if c != "domain"], "name", "n")
    hosts = run.discovered.select("domain", urls.host(F.col("url")).alias("host")).distinct()
    parts = [
        rows(ordered, "finding", finding, F.col("rank")), rows(run.warnings, "warning", warning, F.col("seq")),
        rows(counts, "count", F.concat("name", F.lit("="), F.col("n").cast("string"))),
        rows(hreflang_targets(run.pages), "hreflang_target", F.col("hreflang")),
        rows(scored.candidate_paths(run.discovered), "candidate_language_path", F.col("path")), rows(hosts, "subdomain", F.col("host")),
    ]
    out = debug_snapshot(run.discovered, run.pages, run.cfg)
    for part in parts:
        out = out.unionByName(part)
    return out


def batch_manifest(domains: DataFrame) -> DataFrame:
    """(domain, file) rows of a debug run and, by :func:`manifest_totals`, the number of domains and files."""
    slug = render.domain_slug(F.col("domain"))
    files = F.array(F.concat(slug, F.lit(".discovery.json")), F.concat(slug, F.lit(".language_debug.json")))
    return domains.select("domain").distinct().select("domain", F.explode(files).alias("file"))


def manifest_totals(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.countDistinct("domain").alias("domain_count"), F.countDistinct("file").alias("file_count")
    )


# fixed values: header lines of the two summaries
SUMMARY_HEADER = ["Domain Name", "Language Count", "Languages", "Review Recommended"]
SITE_HEADER = ["Domain Name", "Status", "Language Count", "Languages", "Review Recommended"]
DEBUG_FOLDERS = 64


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """The four-column summary under its published header."""
    write_csv(summary.toDF(*SUMMARY_HEADER), path)


def write_site_csv(report: DataFrame, path: str) -> None:
    """The lines of the site CSV in order of the domain, with the header in the first file."""
    write_lines(site_csv(report), path, "domain", head=[",".join(SITE_HEADER)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_lines(df: DataFrame, path: str, order: str, line: str = "line", head: list[str] = ()) -> None:
    """Lines in order over all files; ``head`` goes into the first file."""
    lines = df.select(F.struct(F.lit(1).alias("p"), F.col(order).cast("string").alias("o")).alias("k"), F.col(line).alias("value"))
    if head:
        spark = df.sparkSession
        top = spark.createDataFrame([(f"{i:09d}", h) for i, h in enumerate(head)], "o string, value string")
        lines = top.select(F.struct(F.lit(0).alias("p"), "o").alias("k"), "value").unionByName(lines)
    lines.orderBy("k").select("value").write.text(path)


def write_debug(rows: DataFrame, path: str) -> None:
    """A fixed number of folders, whatever the number of domains; each row names its domain's slug."""
    bucket = F.pmod(F.xxhash64("domain"), F.lit(DEBUG_FOLDERS))
    named = rows.withColumn("slug", render.domain_slug(F.col("domain"))).withColumn("bucket", bucket)
    named.repartition("bucket").sortWithinPartitions("slug", "kind", "position").write.partitionBy("bucket").json(path)
