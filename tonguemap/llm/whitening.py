"""Whitening of embeddings by a covariance that weighs each distinct vector by its multiplicity.

A component c of a vector becomes the whole number x = floor(64 c) + 1000000, so vectors that are nearly
equal become one. Distinct x vectors are counted once, and all further work is done on them:

1. Equal x vectors are grouped, pre-aggregated per task, so a vector that a third of all rows share is one row.
2. Totals: n, the sum of the fit weights, and S, the weighted sum per dimension, as exact integers.
3. A weighted GEMM of the centred vectors: each task adds up one matrix over its blocks, the rows of these
   matrices are added up by Spark, and only the sum (dimensions squared, whatever the number of vectors)
   goes to the driver for its eigenvectors. Vectors are centred as the integers n x - S before they are
   divided and multiplied, so the common offset costs no digits.
4. Each distinct vector is whitened once, and the covariance of the results is taken the same way.
5. Results are joined back to the rows. Vectors that many rows share are few and broadcast; the others are
   joined by their digest.

Weights are the counts (the fit list is all rows) or one (the fit list is the distinct vectors).

Vectors that are null, empty, or hold null or non-finite entries have no rows in the result. All vectors of a
table should have one length; others than the most frequent length (the largest of equals) are left out too.
Entries are bounded to 2^40 in size before they are made whole. Directions without variance (fewer vectors than
dimensions, or one vector only) have no component, so there may be fewer than asked for, or none. Eigenvectors
have the sign that makes their largest entry positive. A deviation that does not fit in a long is null. Repeated rows and ids
give a row each, null ids stay null, further columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonguemap.llm.common import slices
from tonguemap.operators.stage import stage

SCALE, OFFSET = 64, 1_000_000
LIMIT = 2.0**40
COMPONENTS = 32
ROWS = 1024  # vectors in a block
SHARE = 1e-3  # of all rows, that make a vector frequent
FLAT = 1e-12  # of the largest eigenvalue, that an eigenvalue must be over


def whole_vectors(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, x, key) of the vectors that take part; key is a digest of x."""
    c = F.col(vector)
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    given = rows.select(F.col(vec_id).alias("vec_id"), c.alias("v")).where(c.isNotNull() & (F.size(c) > 0) & finite)
    bounded = lambda e: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), e.cast("double")))
    x = F.transform("v", lambda e: F.floor(bounded(e) * SCALE).cast("long") + OFFSET)
    out = given.select("vec_id", x.alias("x")).withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256)))
    return stage(out, "whole-vectors")


@dataclass(frozen=True)
class Fit:
    """n, S and the components; what tasks need of the model: dimensions x components numbers."""

    n: int
    sums: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column for each
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        if self.n * int(np.abs(x).max(initial=0)) < 1 << 62 and int(np.abs(self.sums).max(initial=0)) < 1 << 62:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.vectors / np.sqrt(self.values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows, their x as a matrix and their weights; columns x and w come last."""
    for batch in slices(batches, ROWS):
        if batch.num_rows:
            x = batch.column(batch.num_columns - 2).flatten().to_numpy().reshape(batch.num_rows, -1)
            yield batch, x, batch.column(batch.num_columns - 1).to_numpy()


def _totals(groups: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for _, x, w in _blocks(batches):
            n += int(w.sum())
            exact = int(np.abs(x).max()) * int(w.sum()) < 1 << 62
            y, k = (x, w) if exact else (x.astype(object), w.astype(object))
            sums = sums + (y * k[:, None]).sum(axis=0).astype(object)
        if n:
            text = pa.array([str(s) for s in [n, *sums]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(text), dtype=np.int32)), text], names=["at", "total"])

    parts = groups.select("x", "w").mapInArrow(run, "at int, total string")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row for each dimension
    totals = [int(r.total) for r in sorted(found)]
    return (totals[0], totals[1:]) if totals else (0, [])


def _gram(groups: DataFrame, of) -> np.ndarray | None:
    """Weighted sum of the outer products of ``of(x)`` over all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x, w in _blocks(batches):
            y = of(x)
            part = y.T @ (y * w[:, None])
            total = part if total is None else total + part
        if total is not None:
            lines = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lines], names=["at", "line"])

    def add(table: pa.Table) -> pa.Table:
        lines = table.column("line").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table({"at": table.column("at").slice(0, 1), "line": pa.array([lines.sum(axis=0)], pa.list_(pa.float64()))})

    schema = "at int, line array<double>"
    parts = groups.select("x", "w").mapInArrow(run, schema)
    lines = sorted(parts.groupBy("at").applyInArrow(add, schema).collect())  # dimensions squared
    return np.array([r.line for r in lines]) if lines else None


def _fit(groups: DataFrame, components: int) -> Fit | None:
    n, sums = _totals(groups)
    if not n:
        return None
    small = max(map(abs, sums)) < 1 << 62
    start = Fit(n, np.array(sums, np.int64 if small else object), np.zeros(0), np.zeros((0, 0)), 0.0)
    v = _gram(groups, lambda x: start.centred(x).astype(np.float64) / n) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(components, int((values > max(values[0], 0.0) * FLAT).sum()))
    values, vectors = values[:some], vectors[:, :some]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(some)])
    return Fit(n, start.sums, values, vectors * signs, float(np.trace(v)))


def _whitened(groups: DataFrame, model: Fit) -> DataFrame:
    """(key, k, deviation, z) for each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, _ in _blocks(batches):
            centred = model.centred(x)
            z = pa.array(list(model.whiten(centred)), pa.list_(pa.float64()))
            if centred.dtype != object and int(np.abs(centred).max()) ** 2 * centred.shape[1] < 1 << 63:
                deviation = pa.array((centred * centred).sum(axis=1))
            else:
                exact = [sum(int(e) ** 2 for e in line) for line in centred]
                deviation = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], deviation, z], names=["key", "k", "deviation", "z"])

    schema = "key binary, k long, deviation long, z array<double>"
    return stage(groups.select("key", "k", "x", "w").mapInArrow(run, schema), "whitened")


def whiten(
    rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS, weights: str = "counts",
) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation (sum of (n x - S)^2), whitened (x - S/n on
    the component, over the root of its eigenvalue), explained (share of the variance), identity_error."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    whole = whole_vectors(rows, vector, vec_id)
    sizes = whole.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    whole = whole.where(F.size("x") == (sizes.size if sizes else 0))
    groups = whole.groupBy("key", "x").agg(F.count(F.lit(1)).alias("k"))
    groups = stage(groups.withColumn("w", F.col("k") if weights == "counts" else F.lit(1).cast("long")), "distinct-vectors")
    model = _fit(groups, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], _result(whole.schema["vec_id"].dataType))
    gram = _gram(groups, lambda x: model.whiten(model.centred(x))) / model.n
    error = float(np.abs(gram - np.eye(len(gram))).max())
    done = _whitened(groups, model)
    # at most 1 / SHARE vectors are frequent, of some components numbers each
    frequent = F.col("k") >= max(2.0, SHARE * (sizes["count"] if sizes else 0))
    ids = whole.select("vec_id", "key")
    hot = F.broadcast(done.where(frequent))
    cold = ids.join(F.broadcast(done.where(frequent).select("key")), "key", "left_anti").join(done.where(~frequent), "key")
    back = ids.join(hot, "key").unionByName(cold)
    explained = F.lit([float(e) / model.trace for e in model.values])
    out = back.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def _result(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("vec_id", kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
