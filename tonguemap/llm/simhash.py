"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each bit that is set in over half of the hashes of a text's shingles. Two
fingerprints link when they differ in at most ``radius`` bits, and a document's group is its component.

Candidates come from 2^(radius + 1) - 1 tables. Each bit position has a nonzero vector of radius + 1
bits, and table ``a`` looks at the positions whose vector has odd parity under ``a``. The vectors of any
``radius`` differing positions leave some ``a`` with which they all are even, so in that table the two
fingerprints are equal: every pair within the radius meets, whatever it is.

Equal fingerprints are one node. Inside a bucket of at most ``SMALL`` fingerprints all pairs are tried.
Fingerprints of larger buckets are linked exactly without pairs: two of them are within the radius just
when some value lies within half the radius of both, so each lists the values around it, and those that
list a value are chained in sorted order. The number of such values depends on the radius alone.

Null and empty texts have the fingerprint zero and link like any other. Fewer words than a shingle has
make one shingle. Repeated rows have the same fingerprint and group, whatever their ids; rows without
an id take the group of their fingerprint. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.llm.common import slices, utf8
from tonguemap.llm.components import components
from tonguemap.operators.stage import stage

BITS = 64
SEED = 42
SHINGLE = 4
RADIUS = 4
SMALL = 32
CHUNK = 1 << 15  # shingles that are counted at a time


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), CHUNK):
        part = [digest(joined[s:e], SEED) for s, e in zip(starts[i : i + CHUNK], ends[i : i + CHUNK])]
        octets = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * votes > len(starts), bitorder="little")
    return int(majority.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    given = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("t"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, fp long")


def masks(radius: int) -> list[int]:
    """The bit positions of each table, as signed 64-bit numbers."""
    vectors = (1 << radius + 1) - 1
    of_bit = [i % vectors + 1 for i in range(BITS)]
    out = [sum(1 << i for i, v in enumerate(of_bit) if (v & a).bit_count() % 2) for a in range(1, vectors + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def _around(fps: DataFrame, radius: int) -> DataFrame:
    """(mid, fp): every value within ``radius`` bits of each fingerprint."""
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(i))
    some = fps.select("fp", F.lit(0).alias("i"), F.lit(0).cast("long").alias("flip"))
    for _ in range(radius):  # ascending positions, the same one again for fewer bits
        some = some.withColumn("j", F.explode(F.sequence("i", F.lit(BITS - 1)))).select(
            "fp", F.col("j").alias("i"), F.col("flip").bitwiseOR(one("j")).alias("flip"))
    each = some.select("fp", "flip").unionByName(fps.select("fp", F.lit(0).cast("long").alias("flip")))
    return each.select(F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within the radius, and no others.

    ``fps`` has each fingerprint once. Pairs in small buckets are all given; those in larger ones are
    connected through chains.
    """
    if radius % 2:
        raise ValueError("the radius must be even, so that pairs have a value half way")
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(masks(radius))])
    keyed = fps.withColumn("x", F.explode(tables)).select("fp", "x.t", F.col("fp").bitwiseAND(F.col("x.m")).alias("key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes the exploded rows for as small as the table they come from, and would broadcast them
    members = stage(keyed.hint("merge").join(sizes, ["t", "key"]), "buckets")
    group = members.where(F.col("n") <= small).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("g"))

    def close(x: Column, i: Column) -> Column:
        later = F.slice("g", i + 2, F.size("g"))
        near = F.filter(later, lambda y: F.bit_count(x.bitwiseXOR(y)) <= radius)
        return F.transform(near, lambda y: F.struct(x.alias("a"), y.alias("b")))

    direct = group.select(F.explode(F.flatten(F.transform("g", close))).alias("e")).select("e.a", "e.b")
    dense = members.where(F.col("n") > small).select("fp").distinct()
    before = F.lag("fp").over(Window.partitionBy("mid").orderBy("fp"))
    chained = _around(dense, radius // 2).select(before.alias("a"), F.col("fp").alias("b")).where("a is not null")
    return direct.unionByName(chained).distinct()


def groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fp, and component_id, the smallest id of its group.

    Everything after the first step works on distinct fingerprints. The last join is on the fingerprint,
    of which one may be in a third of all rows; its other side has one row, so the hot side can be split.
    """
    rows = stage(fingerprints(docs, text, doc_id, shingle), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct.select("fp"), radius))
    labels = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    labels = stage(labels.select("fp", "first", F.coalesce("component", "fp").alias("root")), "roots")
    roots = labels.groupBy("root").agg(F.min("first").alias("component_id"))
    # equal rows compress to next to nothing, so the size of the written table says little about their number
    return rows.hint("merge").join(labels.select("fp", "root").join(roots, "root").drop("root"), "fp").select("doc_id", "fp", "component_id")


def digests(docs: DataFrame) -> DataFrame:
    return groups(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    A document is what agrees in id and text: rows of unlike texts stay apart also where they share an id
    or have none. A group keeps one without an id only if none of its rows has an id; of the texts that
    share the smallest id, the one with the least hash stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    keyed = docs.withColumn("_key", key)
    found = groups(keyed, doc_id="_key", shingle=shingle, radius=radius)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id.id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct()
    same = F.col("_key.id").eqNullSafe(F.col("_id")) & F.col("_key.h").eqNullSafe(F.col("_h"))
    return keyed.join(first, same, "left_semi").dropDuplicates(["_key"]).drop("_key")
