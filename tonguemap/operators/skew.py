"""Grouping and joining by keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT


def keep_first(df: DataFrame, keys: list[str], order: list[str], carry: list[str] = ()) -> DataFrame:
    """First row per key by ``order``: an aggregate, so each task sends one row per key."""
    first = F.min_by(F.struct(*[F.col(c) for c in [*order, *carry]]), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows per key with their rank. Spark limits groups before the shuffle,
    so a hot key sends at most ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def small_enough(df: DataFrame, max_rows: int = DEFAULT.max_broadcast_rows) -> bool:
    """Does ``df`` have at most ``max_rows`` rows? Reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def running_count(df: DataFrame, key: list[str], bucket: str, order: list[str], out: str, total: str) -> DataFrame:
    """Running row count per key in ``order`` and the key's total, where ``bucket`` grows with that order.

    Counting runs in two levels: inside each (key, bucket), plus the totals of the key's earlier buckets.
    No task holds all rows of a key, only its list of bucket totals; all rows move once, by (key, bucket).
    """
    totals = df.groupBy(*key, bucket).agg(F.count(F.lit(1)).alias("_n"))
    per_key = Window.partitionBy(*key)
    before = per_key.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *key, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(per_key).alias(total)
    )
    inner = Window.partitionBy(*key, bucket).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inner))
    return ranked.join(offsets, [*key, bucket]).withColumn(out, F.col("_rn") + F.col("_before")).drop("_rn", "_before")
