"""Near-duplicate vectors by random-hyperplane signs, exact cosines and connected components.

The signs of a vector against ``bits`` random hyperplanes are its key in a table; two vectors of cosine
c agree in one sign with probability 1 - acos(c) / pi, and so meet in at least one of ``tables`` tables
with a known probability. ``tables_for`` gives the number of tables for a recall at the threshold itself;
closer pairs are found more surely. More distinct vectors than 2^16 get more bits (log2 of their number), so
that buckets of unlike vectors stay short, and with them more tables.

Equal vectors are one node that counts how often it occurs. Buckets are cut into blocks of about
``BLOCK`` vectors; each pair of blocks of a bucket is compared as one matrix product, so a bucket that
holds a third of all vectors is spread over many tasks of bounded size. A pair is counted in the first
table in which it meets and never listed: a block pair gives numbers of links per vector, and edges
that connect what it linked.

Vectors that are null, zero, or hold null or non-finite components link with nothing; they are their own
component. Vectors of different lengths never link.
Repeated rows of an id count as vectors of their own that link with each other. Labels and further
columns are ignored. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.llm.components import components
from tonguemap.operators.stage import stage

COSINE = 0.9
BITS = 16  # at least
RECALL = 0.95
BLOCK = 512
SEED = 3


def tables_for(bits: int = BITS, cosine: float = COSINE, recall: float = RECALL) -> int:
    """Tables in which a pair of just this cosine meets at least once with this probability."""
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def bits_for(vectors: int) -> int:
    """Bits of a key for so many distinct vectors."""
    return max(BITS, math.ceil(math.log2(max(vectors, 1))))


def planes(dims: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, bits * tables))


def sign_keys(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Key of each vector in each table."""
    signs = vectors @ planes(vectors.shape[1], bits, tables) > 0
    weights = 1 << np.arange(bits, dtype=np.int64)
    return signs.reshape(len(vectors), tables, bits) @ weights


def _with_keys(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.cumsum(sizes) - sizes
            keys = np.empty((len(sizes), tables), np.int64)
            for dims in np.unique(sizes):
                of = np.flatnonzero(sizes == dims)
                block = flat[at[of][:, None] + np.arange(dims)]
                # lengths are scaled away; the largest component keeps squares from overflowing
                block = block / np.abs(block).max(axis=1, keepdims=True)
                keys[of] = sign_keys(block, bits, tables)
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))], names=[*batch.schema.names, "keys"])

    return nodes.mapInArrow(run, "node long, n long, v array<double>, keys array<long>")


def _local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric matrix of links."""
    root = np.arange(len(linked))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(axis=1, initial=len(root)))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def compare(ids: np.ndarray, n: np.ndarray, vectors: np.ndarray, keys: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, cosine: float) -> tuple:
    """Links between rows ``left`` and rows ``right`` of a bucket: (ids, links, roots) of the linked rows.

    Pairs that share an earlier table are left to it for counting.
    """
    both = vectors[left] @ vectors[right].T >= cosine
    for t in range(table):
        both &= keys[left, t][:, None] != keys[right, t][None, :]
    whole = np.zeros((len(ids), len(ids)), bool)
    whole[np.ix_(left, right)] = both
    whole |= whole.T
    np.fill_diagonal(whole, False)
    of = np.flatnonzero(whole.any(axis=1))
    if not len(of):
        return ids[:0], n[:0], ids[:0]
    inner = whole[np.ix_(of, of)]
    return ids[of], inner @ n[of], ids[of][_local_roots(inner)]


def _compare_sorted(cosine: float):
    """Links of each (table, key, dims, i, j) run of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(block: pa.Table) -> Iterator[pa.RecordBatch]:
            names = ("t", "key", "dims", "i", "j")
            runs = np.stack([block.column(c).to_numpy() for c in names])
            first = np.flatnonzero(np.append(True, (runs[:, 1:] != runs[:, :-1]).any(axis=0)))
            ids, n, side = (block.column(c).to_numpy() for c in ("node", "n", "side"))
            flat = [block.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("v", "keys")]
            sizes = runs[2]
            at, tables = np.cumsum(sizes) - sizes, len(flat[1]) // block.num_rows
            out = []
            for s, e in zip(first.tolist(), [*first[1:].tolist(), block.num_rows]):
                if e - s < 2:
                    continue
                v = flat[0][at[s] : at[e - 1] + sizes[e - 1]].reshape(e - s, -1)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                k = flat[1][s * tables : e * tables].reshape(e - s, tables)
                same = runs[3, s] == runs[4, s]
                left = np.arange(e - s) if same else np.flatnonzero(side[s:e] == runs[3, s])
                right = left if same else np.flatnonzero(side[s:e] == runs[4, s])
                out.append(compare(ids[s:e], n[s:e], v, k, left, right, int(runs[0, s]), cosine))
            columns = [pa.array(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64)) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "links", "root"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                new = pa.Table.from_batches([batch.slice(at, 4 * BLOCK)])
                held = new if held is None else pa.concat_tables([held, new])
                runs = np.stack([held.column(c).to_numpy() for c in ("t", "key", "dims", "i", "j")])
                change = np.flatnonzero((runs[:, 1:] != runs[:, :-1]).any(axis=0))
                if len(change):  # the last run may go on
                    yield from done(held.slice(0, int(change[-1]) + 1))
                    held = held.slice(int(change[-1]) + 1)
        if held is not None and held.num_rows:
            yield from done(held)

    return run


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
    bits: int | None = None, recall: float = RECALL, block: int = BLOCK,
) -> DataFrame:
    """Per vector: vec_id, n_links, component_id (smallest id reachable) and kept."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    # 0.0 + x makes -0.0 equal to 0.0
    given = vectors.select(F.col(vec_id).alias("vec_id"), F.when(fine, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    given = stage(given, "vectors")
    nodes = given.where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bits = bits_for(nodes.count()) if bits is None else bits
    tables = tables_for(bits, cosine, recall)
    keyed = stage(_with_keys(nodes.select("node", "n", "v"), bits, tables), "keys")

    dims = F.size("v").alias("dims")
    places = keyed.select("node", dims, F.posexplode("keys").alias("t", "key"))
    sizes = places.groupBy("t", "key", "dims").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    members = places.join(sizes, ["t", "key", "dims"]).withColumn("blocks", blocks)
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a row goes to the pairs of its block with each block of the bucket
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = members.select("node", "t", "key", "dims", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    run = ["t", "key", "dims", "i", "j"]
    rows = pairs.join(keyed, "node").select(*run, "side", "node", "n", "v", "keys").repartition(*run).sortWithinPartitions(*run)
    found = stage(rows.mapInArrow(_compare_sorted(cosine), "node long, links long, root long"), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of = nodes.select("node", "n", "v", "first").join(links, "node", "left").join(parts, "node", "left")
    of = stage(of.withColumn("root", F.coalesce("component", "node")), "roots")
    least = of.groupBy("root").agg(F.min("first").alias("least"))
    label = of.join(least, "root").select(
        F.col("v").alias("_v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "least")
    # a vector that a third of the rows hold has one row on the other side; the hot side can be split
    out = given.join(label, F.col("v") == F.col("_v"), "left")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
