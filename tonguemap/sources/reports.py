"""Reading published reports and summaries back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.functions import render
from tonguemap.functions.urls import strip

REPORT_SCHEMA = """
    domain STRING, language_count BIGINT, languages ARRAY<STRING>,
    findings ARRAY<STRUCT<code: STRING, name: STRING, confidence_percent: BIGINT, confidence_label: STRING,
                          sources: ARRAY<STRING>, sample_urls: ARRAY<STRING>>>,
    warnings ARRAY<STRUCT<type: STRING, language: STRING, code: STRING, url: STRING, message: STRING>>,
    warning_count BIGINT, discovery_counts MAP<STRING, BIGINT>
"""


def read_reports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Report documents: JSON lines, or one JSON array per file with ``multi_line``."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", multi_line).json(path)


def summary_from_reports(reports: DataFrame) -> DataFrame:
    """Summary rows of nested reports; the languages list stands in where there are no findings."""
    labels = F.array_compact(
        F.transform(
            "findings",
            lambda f: render.language_label(f["name"], f["confidence_label"], f["confidence_percent"]),
        )
    )
    plain = F.filter(F.transform("languages", strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    shown = F.when(F.coalesce(F.size("findings"), F.lit(0)) > 0, labels).otherwise(F.coalesce(plain, none))
    warned = (F.coalesce(F.size("warnings"), F.lit(0)) > 0) | (F.coalesce("warning_count", F.lit(0)) > 0)
    return _summary_rows(reports.withColumn("_l", shown), warned)


def read_report_csv(spark: SparkSession, path: str) -> DataFrame:
    """Report CSV files by their header; quotes inside a cell are doubled."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def summary_from_csv(reports: DataFrame) -> DataFrame:
    """Summary rows of the flat report; languages are counted again, ``[]`` or 0 means no warnings."""
    parts = F.filter(F.transform(F.split(F.coalesce("languages", F.lit("")), ";"), strip), lambda x: x != "")
    warned = ~strip(F.coalesce("warnings", F.lit(""))).isin("", "[]", "0")
    return _summary_rows(reports.withColumn("_l", parts), warned)


def _summary_rows(df: DataFrame, warned: Column) -> DataFrame:
    return df.select(
        strip(F.coalesce("domain", F.lit(""))).alias("domain_name"),
        F.size("_l").cast("string").alias("language_count"),
        F.array_join("_l", "; ").alias("languages"),
        render.yes_no(warned | (F.size("_l") == 0)).alias("review_recommended"),
    )


# fixed values: accepted spellings of the summary columns, best first, and what stands in for nothing
SUMMARY_ALIASES = {
    "domain": (["domain", "DomainName", "Domain Name"], ""),
    "count": (["languageCount", "LanguageCount", "Language Count"], ""),
    "languages": (["languages", "Languages"], ""),
    "review": (["reviewRecommended", "ReviewRecommended", "Review Recommended"], "No"),
}
# spellings whose value is a number, where 0 counts as missing like an empty text does
_NUMERIC_SPELLINGS = {"languageCount", "LanguageCount"}


def normalize_summary(rows: DataFrame, row: str = "row") -> DataFrame:
    """One spelling for summaries that come in several. ``row`` is a map, since its keys differ by case."""
    def value(name: str) -> Column:
        v = F.try_element_at(row, F.lit(name))
        return F.when(v.isin("", "0") if name in _NUMERIC_SPELLINGS else v == "", None).otherwise(v)

    return rows.select(
        *[F.coalesce(*map(value, names), F.lit(d)).alias(out) for out, (names, d) in SUMMARY_ALIASES.items()]
    )


def read_summary(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Summary rows as maps: from JSON lines, or from one JSON array per file with ``whole_files``."""
    raw = spark.read.text(path, wholetext=whole_files)
    if whole_files:
        return raw.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("row"))
    return raw.select(F.from_json("value", "map<string,string>").alias("row"))
