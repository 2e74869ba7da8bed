"""Domain lists as they arrive: files, pasted tokens, pasted lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.functions.urls import WS, strip
from tonguemap.operators.skew import keep_first


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a key that follows file order: (file, offset of the split, line within it)."""
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("seq"),
        "value",
    )


def domains_from_lines(lines: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """First comma field of each line that is no header; first of equals kept, ``given`` domains first.

    ``lines`` and ``given`` are (seq, value). The header test drops any line that starts with "domain".
    """
    bare = F.regexp_replace(strip(F.col("value")), "^,+|,+$", "")
    kept = lines.select("seq", bare.alias("line")).where(
        (F.col("line") != "") & ~F.lower("line").startswith("domain")
    )
    found = kept.select("seq", strip(F.element_at(F.split("line", ","), 1)).alias("domain"), F.lit(1).alias("part"))
    if given is not None:
        found = found.unionByName(given.select("seq", F.col("value").alias("domain"), F.lit(0).alias("part")))
    return keep_first(found, ["domain"], ["part", "seq"])


def domains_from_tokens(values: DataFrame) -> DataFrame:
    """Tokens between commas and white space, the word "domain" aside; first of equals kept."""
    tokens = F.split(F.replace(F.col("value"), F.lit(","), F.lit(" ")), f"{WS}+")
    return keep_first(
        values.select("seq", F.posexplode(tokens).alias("pos", "domain")).where(
            (F.col("domain") != "") & (F.lower("domain") != "domain")
        ),
        ["domain"],
        ["seq", "pos"],
    )


def split_lines(values: DataFrame) -> DataFrame:
    """Trimmed non-empty lines with their position; equal lines all stay."""
    return values.select("seq", F.posexplode(F.split("value", "\n")).alias("pos", "line")).select(
        "seq", "pos", strip(F.col("line")).alias("line")
    ).where(F.col("line") != "")


def split_tokens(values: DataFrame) -> DataFrame:
    """Tokens between commas and white space; equal tokens all stay."""
    return values.select("seq", F.posexplode(F.split("value", f"(?:{WS}|,)+")).alias("pos", "token")).where(
        F.col("token") != ""
    )
