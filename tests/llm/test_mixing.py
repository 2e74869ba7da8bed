import random

import pytest
from pyspark.sql import functions as F

from tonguemap.llm import mixing


def waterfill(sizes):
    """Targets by repeated resharing; sizes by source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    names = ["a", "é", "z", "😀", None, "b", "B", "hot"]
    out = []
    for i in range(900):
        s = rng.choice(names[:-1]) if i % 3 else "hot"
        n = rng.choice([0, 1, 5, 40, 300]) if s != "b" else 2
        out.append((i, None if i == 7 else "\n".join(f"w{i}_{j}" for j in range(n)) + "  ", "en", s, n))
    return [*out, out[5], (None, "x y", "en", "a", 1), (None, "x y", "en", "a", 1), (5000, " ".join(map(str, range(20_000))), "en", "a", 9)]


def test_mix(spark, rows):
    docs = corpus(spark, rows).withColumn("size", F.lit("own")).withColumn("rank", F.lit(1))
    got = mixing.mix(docs).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len((r[1] or "").split())) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    want = waterfill(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert (r.source_size, pytest.approx(r.target)) == (sizes[s], want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 130), s
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 7")).collect()] == [0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 97, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(4)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    if n >= 64:
        assert sum(r.p == i for i, r in enumerate(got)) < n / 8


def test_draws_sum_to_slots(spark):
    sized = spark.range(30_000).select(F.concat(F.lit("s"), F.col("id") % 11).alias("source"), (F.col("id") % 97).alias("size"))
    targets = mixing.source_targets(sized)
    counts = mixing.slot_counts(targets, 16, 500).groupBy("shard").agg(F.sum("n_slots").alias("n")).orderBy("shard").collect()
    assert all(r.n == 500 for r in counts[:-1]) and 0 < counts[-1].n <= 500 and len(counts) > 100


def test_texts(spark, rows):
    plain = [r for r in {(r[0], r[1]): r for r in rows}.values() if r[0] is not None]
    docs = corpus(spark, plain)
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = {}
    for r in mixing.mixed_texts(docs).collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.doc_id, []).append(r.text.split())
    given = {r[0]: (r[1] or "").split() for r in plain}
    assert {i: sum(map(len, t)) for i, t in out.items()} == {i: n for i, n in taken.items() if n}
    for i, texts in out.items():
        assert len(texts) <= 3
        places = {w: j for j, w in enumerate(given[i])}
        for t in texts:
            at = [places[w] for w in t]
            assert at == sorted(set(at))
    assert mixing.mixed_texts(docs.limit(0)).count() == 0


def test_equal_rows_are_split(spark, monkeypatch):
    """A third of all rows has no id and one size: no bucket holds them, and each is mixed for itself."""
    same = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'hot' AS source", "7L AS size")
    other = spark.range(200_000).selectExpr("id AS doc_id", "concat('s', id % 5) AS source", "1 + id % 9 AS size")
    sized = same.unionByName(other)
    largest = []
    running_sum = mixing.running_sum

    def noted(df, key, bucket, *more):
        if "_mixed" in df.columns:
            largest.append(df.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0])
        return running_sum(df, key, bucket, *more)

    monkeypatch.setattr(mixing, "running_sum", noted)
    parts = mixing.pieces(sized, mixing.source_targets(sized))
    per_row = parts.groupBy("rank", "first", "doc_id", "size").agg(F.sum("n").alias("n"))
    assert per_row.where("doc_id IS NULL").count() == 100_000
    assert per_row.where("n <> size").count() == 0 and per_row.count() == 300_000
    assert largest == [max(largest)] and largest[0] < mixing.BUCKET_ROWS
    # places of a source are its words from 0 on, without gaps
    ends = per_row.groupBy("rank").agg(F.min("first").alias("a"), F.max(F.col("first") + F.col("size")).alias("b"), F.sum("size").alias("n"), F.countDistinct("first").alias("d"), F.count(F.lit(1)).alias("c"))
    assert all(r.a == 0 and r.b == r.n and r.d == r.c for r in ends.collect())


def test_blocks_are_not_broadcast(spark, rows):
    """A block takes some bytes where it is written, and a hundred in a broadcast: two millions of them were sent as small."""
    sized = corpus(spark, rows).select("doc_id", "source", F.lit(50).cast("long").alias("size"))
    plan = mixing.pieces(sized, mixing.source_targets(sized))._jdf.queryExecution().sparkPlan().toString()
    assert next(line for line in plan.splitlines() if "Join" in line).lstrip(" +-:").startswith("SortMergeJoin")
