"""Connected components of an edge table, by alternating large and small stars.

A large star links every larger neighbour of a node to the smallest node it sees, a small star does so
with the smaller neighbours. Both keep components as they are; repeated, they end in one star around the
smallest node of each component, after a number of rounds that grows with the logarithm of its size.
Every round is a written table, so lost executors repeat one round at most. Minima are pre-aggregated
before each shuffle, and the hot side of a join with a node of very many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.operators.stage import stage


def _least(of: DataFrame) -> DataFrame:
    """Smallest neighbour of each node u of (u, v)."""
    return of.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has an edge; the component is its smallest node.

    Edges to itself and with a null end are passed over. Nodes are of any ordered type.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    now = stage(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = _least(large)
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, state = state, _state(now)
    member = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
