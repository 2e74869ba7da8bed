"""Mixing sources to target weights, in column expressions only.

The words of a source, document after document in a pseudorandom order of documents, are packed into
blocks of fixed length. Output slots are dealt to shards; each shard draws how many of its slots go to
each source; the slots of a source, numbered through all shards, are mapped to its blocks by a
pseudorandom permutation of block numbers, one per pass over the source; and blocks are joined by number.

* The multinomial draw of a shard gives each source the whole part of its expected slots and draws only
  the rest, which keeps the expectation and removes most of the noise.
* A permutation is a swap-or-not shuffle: a fixed number of rounds that each swap a number with its
  mirror image or not, a bijection for any number of blocks, computed per slot without a table.
* Running sums are taken in two levels, inside buckets of bounded size and over bucket totals, so no
  task holds a whole source. Equal rows, as all rows of one size without an id may be, are counted and dealt as runs of
  ``COPIES`` at most, which lie one behind the other. What is drawn depends on hashes only, so reruns agree.

Null texts have size 0; documents of size 0 are never taken. A null source is the last source. Repeated
rows are mixed each for itself. Texts of any length are measured whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.llm.common import n_words
from tonguemap.operators.stage import stage

BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MAX_PASSES = 3
WEIGHTS = 3  # sources weigh 1, 2, …, WEIGHTS, repeating
BUCKET_ROWS = 2_000
COPIES = 1_000
ROUNDS = 16
SEED = 20_081


def uniform(*of: Column | int) -> Column:
    """A number in [0, 1) that depends on the arguments only."""
    h = F.xxhash64(F.lit(SEED), *[F.lit(x) if isinstance(x, int) else x for x in of])
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def permuted(i: Column, n: Column, *seed: Column) -> Column:
    """The place of ``i`` in a pseudorandom permutation of 0 … n - 1."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.xxhash64(F.lit(SEED), r, *seed) - x, n)
        bit = F.xxhash64(F.lit(SEED + 1), r, F.greatest(x, mirror), *seed).bitwiseAND(F.lit(1))
        return F.when(bit == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i.cast("long"), swap)


def running_sum(df: DataFrame, key: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same key, in the order of bucket and ``order``."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value).alias("_in_bucket")
    per_key = before(Window.partitionBy(key).orderBy(bucket))
    offsets = df.groupBy(key, bucket).agg(total).withColumn("_before", F.coalesce(F.sum("_in_bucket").over(per_key), F.lit(0)))
    inner = before(Window.partitionBy(key, bucket).orderBy(*order))
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = inside.join(offsets.drop("_in_bucket"), [key, bucket])
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop("_inside", "_before")


def source_targets(sized: DataFrame) -> DataFrame:
    """Per source: rank, source_size and target in words.

    With sources in the order of their cap per weight, the first ones are capped; the level that the
    rest share is the largest of the levels that reach no cap. One row per source meets in one task.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("rank", F.row_number().over(ranked).cast("long"))
    sources = sources.withColumn("weight", F.pmod(F.col("rank") - 1, F.lit(WEIGHTS)) + 1)
    sources = sources.withColumn("cap", F.col("source_size") * MAX_PASSES)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0).cast("long")
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), zero)
    share = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), zero)
    sources = sources.withColumn("level", left / share)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    level = F.max(fits).over(whole)
    return sources.select(
        "source", "rank", "source_size",
        F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"),
    )


def slot_counts(targets: DataFrame, block_words: int, shard_slots: int) -> DataFrame:
    """Per source and output shard the number of slots drawn: (rank, blocks, shard, n_slots)."""
    whole = Window.partitionBy()
    blocks = F.ceil(F.col("source_size") / block_words)
    want = F.col("target") * F.col("blocks") / F.col("source_size")  # in blocks of the source's mean length
    drawn = targets.where(F.col("source_size") > 0).withColumn("blocks", blocks.cast("long")).withColumn("want", want)
    drawn = drawn.withColumn("_all", F.sum("want").over(whole)).withColumn("slots", F.round("_all").cast("long"))
    last = F.floor((F.col("slots") - 1) / shard_slots)
    rows = drawn.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)))))
    size = F.least(F.lit(shard_slots), F.col("slots") - F.col("shard") * shard_slots)
    rows = rows.withColumn("_e", size * F.col("want") / F.col("_all")).withColumn("_whole", F.floor("_e"))
    in_shard = Window.partitionBy("shard")
    up_to = in_shard.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rest", size - F.sum("_whole").over(in_shard)).withColumn("_part", F.col("_e") - F.col("_whole"))
    rows = rows.withColumn("_high", F.sum("_part").over(up_to) / F.col("_rest"))
    rows = rows.withColumn("_low", F.coalesce(F.lag("_high").over(in_shard.orderBy("rank")), F.lit(0.0)))
    rows = rows.withColumn("_top", F.col("rank") == F.max("rank").over(in_shard))
    hit = lambda j: (uniform(F.col("shard"), j) >= F.col("_low")) & (
        F.col("_top") | (uniform(F.col("shard"), j) < F.col("_high")))
    draws = F.when(F.col("_rest") > 0, F.size(F.filter(F.sequence(F.lit(1).cast("long"), F.col("_rest")), hit))).otherwise(0)
    return rows.select("rank", "blocks", "shard", (F.col("_whole") + draws).alias("n_slots"))


def block_uses(counts: DataFrame) -> DataFrame:
    """How often each block is taken: (rank, block, uses), ``MAX_PASSES`` times at most."""
    numbered = running_sum(counts.withColumn("_b", F.floor(F.col("shard") / 1024)), "rank", "_b", ["shard"], "n_slots", "first")
    # a row here becomes thousands of slots, which Spark can't foresee from the size of the rows
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = numbered.repartition(tasks, "rank", "shard").where(F.col("n_slots") > 0).select(
        "rank", "blocks", F.explode(F.sequence("first", F.col("first") + F.col("n_slots") - 1)).alias("slot")
    )
    slots = slots.withColumn("turn", F.floor(F.col("slot") / F.col("blocks"))).where(F.col("turn") < MAX_PASSES)
    block = permuted(F.col("slot") - F.col("turn") * F.col("blocks"), F.col("blocks"), F.col("rank"), F.col("turn"))
    return slots.select("rank", block.alias("block")).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))


def pieces(sized: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The parts of documents that lie in one block each, with how often the mix takes the block.

    ``sized`` has doc_id, source, size and may have more columns, which are kept: one row per part of
    each document with words, with rank, first (place of its first word in the source), ``at`` (first
    word of the part in the document), n (its words) and uses.
    """
    buckets = sized.count() // BUCKET_ROWS + 1
    # equal rows are counted next to the scan, so that a hot row is one row of each task
    equal = sized.where(F.col("size") > 0).groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    runs = equal.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / COPIES))))
    runs = runs.withColumn("_copies", F.least(F.lit(COPIES), F.col("_n") - F.col("_run") * COPIES))
    keyed = runs.join(
        targets.select(F.col("source").alias("_of"), "rank"), F.col("source").eqNullSafe(F.col("_of"))
    ).drop("_of")
    mixed = F.xxhash64(F.lit(SEED), "doc_id", "size", "_run")
    keyed = keyed.withColumn("_mixed", mixed).withColumn("_bucket", F.pmod("_mixed", F.lit(buckets)))
    keyed = keyed.withColumn("_words", F.col("size") * F.col("_copies"))
    placed = running_sum(keyed, "rank", "_bucket", ["_mixed", "doc_id", "size", "_run"], "_words", "_at")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1))
    placed = placed.withColumn("_copy", copy).withColumn("first", F.col("_at") + F.col("_copy") * F.col("size"))
    placed = placed.drop("_mixed", "_bucket", "_words", "_at", "_copy", "_copies", "_run", "_n")
    span = F.sequence(F.floor(F.col("first") / block_words), F.floor((F.col("first") + F.col("size") - 1) / block_words))
    cut = placed.withColumn("block", F.explode(span))
    start = F.greatest(F.col("first"), F.col("block") * block_words)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * block_words)
    cut = cut.withColumn("at", start - F.col("first")).withColumn("n", end - start)
    # a row per block, which takes some bytes where it is written and a hundred in a broadcast
    uses = stage(block_uses(slot_counts(targets, block_words, shard_slots)), "uses")
    return cut.join(uses.hint("merge"), ["rank", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0).cast("long")))


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Per document: size, source_size, target of its source, and taken, the words that the mix takes of it.

    The columns of each step are narrow: texts are read once, to be measured.
    """
    sized = stage(docs.select("doc_id", F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "sizes")
    targets = stage(source_targets(sized), "targets")
    taken = pieces(sized, targets).groupBy("rank", "first", "doc_id", "size").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"))
    ranks = targets.select("source", "rank", "source_size", "target")
    of = ranks.withColumnRenamed("source", "_of")
    zeros = sized.where(F.col("size") == 0).join(of, F.col("source").eqNullSafe(F.col("_of")))
    out = ["doc_id", "size", "source_size", "target", "taken"]
    return taken.join(ranks.drop("source"), "rank").select(*out).unionByName(
        zeros.withColumn("taken", F.lit(0).cast("long")).select(*out)
    )


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix as documents: pass 1, 2, 3 over a document gives a row with the parts that are taken that often.

    A pass that takes all parts gives the text as it is. ``docs`` has the columns of documents, all of
    which come back; n_chars is counted again. Rows that agree in id and text are mixed alike.
    """
    columns = docs.columns
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    sized = keyed.select("doc_id", "source", "_h", n_words(F.col("text")).alias("size")).dropDuplicates(["doc_id", "_h"])
    sized = stage(sized, "sizes")
    targets = stage(source_targets(sized), "targets")
    part = F.struct("at", "n", "uses")
    parts = pieces(sized, targets).where(F.col("uses") > 0).groupBy("doc_id", "_h", "size").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    right = parts.select(F.col("doc_id").alias("_id"), F.col("_h").alias("_rh"), "size", "_parts")
    joined = keyed.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_rh")))
    turns = joined.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.lit(MAX_PASSES))))
    turns = turns.withColumn("_parts", F.filter("_parts", lambda p: p["uses"] >= F.col("_pass"))).where(F.size("_parts") > 0)
    n = F.aggregate("_parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    tokens = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    taken = F.transform(F.array(tokens), lambda t: F.array_join(
        F.transform("_parts", lambda p: F.array_join(F.slice(t, (p["at"] + 1).cast("int"), p["n"].cast("int")), "")), ""))[0]
    turns = turns.withColumn("text", F.when(n == F.col("size"), F.col("text")).otherwise(taken))
    if "n_chars" in columns:
        turns = turns.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return turns.select(*columns)
