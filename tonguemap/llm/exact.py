"""Exact duplicates of texts, with frequent digests split off before anything is shuffled.

Texts are equal when they are identical after each run of ASCII white space became one space; the SHA-256
of that normalised text stands for it.

1. Digests are written once, with a number for each row, as a narrow table.
2. Misra-Gries counters find what may be frequent: each task keeps a bounded table of counters, all lowered
   together when it is full (Spark's frequent-items sketch). Tables are merged in two levels, so no task
   merges those of all tasks.
3. Candidates are verified: each task counts them exactly and keeps the first row of each. Those that
   make up ``SHARE`` of all rows or more are winners, ``1 / SHARE`` of them at most whatever the data, and
   are broadcast. Their rows, a third of the table or more, get their answer where they are read.
4. All other digests are rare by that proof, and meet in an ordinary shuffle.

Which row stays: the one with the smallest doc_id, ids before null; of rows that share that id too, the one
that was read first, so exactly one row of each group stays. Null texts count as empty, and empty texts are
equal to each other. A group without any id has a null ``keep_id``. Texts of any length are digested whole.
An empty table gives an empty one. Further columns are kept by :func:`without_copies` and ignored by
:func:`duplicates`, of whatever name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.operators.stage import stage

# runs that are not one space already; what is left out would be replaced by itself
RUN = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
SHARE = 1e-4  # of all rows, that make a digest frequent
COUNTERS = 32_768  # of each sketch: its error is some 3.5 / COUNTERS of all rows, about SHARE
MERGERS = 64  # tasks that merge sketches before the last one does


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUN, " ")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256))


def _candidates(digests: DataFrame) -> DataFrame:
    """Hashes of digests that may be frequent, ``COUNTERS`` at most."""
    sketch = F.expr(f"approx_top_k_accumulate(hash, {COUNTERS})").alias("sketch")
    some = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger")).agg(sketch)
    # grouped, if by nothing: without rows a merged sketch has no type, and Spark fails to give it out
    merged = F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {COUNTERS}), {COUNTERS})")
    items = some.groupBy(F.lit("all")).agg(merged.alias("items"))
    return items.select(F.explode("items.item").alias("hash"))


def _digests(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    given = docs.select(F.col(doc_id).alias("doc_id"), _digest(text).alias("digest"))
    numbered = given.withColumn("hash", F.xxhash64("digest")).withColumn("row", F.monotonically_increasing_id())
    return stage(numbered, "digests")


def _winners(digests: DataFrame) -> DataFrame:
    """(digest, group_size, keep) of the frequent digests; keep is the id and the number of the row that stays."""
    least = max(2, math.ceil(SHARE * digests.count()))
    # counted exactly, over whole digests: a hash that two digests share is a candidate for both
    maybe = digests.join(F.broadcast(_candidates(digests)), "hash")
    return stage(maybe.groupBy("digest").agg(*[c.alias(n) for n, c in _verdict().items()]).where(F.col("group_size") >= least), "winners")


def _first(doc_id: str = "doc_id", row: str = "row") -> Column:
    """Orders rows: ids before null, then by id, then as read."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(row).alias("row"))


def _verdict() -> dict[str, Column]:
    return {"group_size": F.count(F.lit(1)), "keep": F.min(_first())}


def _answers(digests: DataFrame) -> DataFrame:
    """Each row of ``digests`` with the size of its group and the row that stays."""
    winners = F.broadcast(_winners(digests))  # SHARE bounds them: 10,000 rows of some 80 bytes
    frequent = digests.join(winners, "digest")
    group = Window.partitionBy("digest")
    rare = digests.join(winners.select("digest"), "digest", "left_anti").withColumns({n: c.over(group) for n, c in _verdict().items()})
    return frequent.select(*rare.columns).unionByName(rare)


def duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    return _answers(_digests(docs, text, doc_id)).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns.

    Rows of frequent digests go where they are read, unless they have the id that stays; what is left meets
    in one shuffle, to which each task sends one row per digest.
    """
    winners = _winners(_digests(docs, text, doc_id)).select("digest", F.col("keep.doc_id").alias("keep_id"), F.lit(True).alias("frequent"))
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(doc_id).alias("doc_id"),
        _digest(text).alias("digest"), F.monotonically_increasing_id().alias("row"))
    left = given.join(F.broadcast(winners), "digest", "left").where("frequent IS NULL OR doc_id <=> keep_id")
    return left.groupBy("digest").agg(F.min_by("given", _first()).alias("given")).select("given.*")
