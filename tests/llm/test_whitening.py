import math
import random

import numpy as np
import pytest

from tonguemap.llm import whitening


def whole(rows):
    out = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(64 * c) + 1_000_000 for c in v]))
    size = max({len(x) for _, x in out}, key=lambda s: (sum(len(x) == s for _, x in out), s), default=0)
    return [(i, x) for i, x in out if len(x) == size]


def brute(rows, components, weights="counts"):
    """{(vec_id, x): (n, deviation, whitened up to sign, explained)} straight from the definition, in exact integers where it can be."""
    x = whole(rows)
    fit = x if weights == "counts" else [(None, v) for v in sorted({tuple(v) for _, v in x})]
    n, sums = len(fit), [sum(c) for c in zip(*(v for _, v in fit))]
    centred = lambda v: [n * c - s for c, s in zip(v, sums)]
    c = np.array([centred(v) for _, v in fit], float) / n
    cov = sum(np.outer(r, r) for r in c) / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for i, v in x:
        z = np.array(centred(v), float) / n @ vectors / np.sqrt(values)
        out[i, tuple(v)] = (n, sum(e * e for e in centred(v)), z, values / np.trace(cov))
    return out


def given(n=400, d=12):
    rng = random.Random(41)
    base = [[rng.gauss(0, 1 + k % 4) for k in range(d)] for _ in range(n)]
    rows = [(i, [a + 0.5 * b for a, b in zip(v, v[1:] + v[:1])]) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1]) for i in range(300)]  # a vector that many rows share
    rows += [(2000 + i, [c + 1e-4 for c in rows[4][1]]) for i in range(3)]
    rows += [(3000, None), (3001, []), (3002, [float("nan")] * d), (3003, [None] * d), (3004, [float("inf")] * d), (3005, [1.0, 2.0]), (None, rows[9][1]), (8, rows[8][1])]
    return rows


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening(spark, weights):
    rows = given()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, k int").repartition(6)
    got = whitening.whiten(table, components=5, weights=weights).collect()
    want = brute(rows, 5, weights)
    kept = whole(rows)
    assert len(got) == 5 * len(kept)
    signs = {}
    of = dict(kept)
    for r in got:
        n, deviation, z, explained = want[r.vec_id, tuple(of[r.vec_id])]
        assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        mine = z[r.component - 1]
        signs.setdefault(r.component, 1.0 if abs(r.whitened - mine) < abs(r.whitened + mine) else -1.0)
        if abs(mine) > 1e-6:
            assert r.whitened * math.copysign(1, signs[r.component]) == pytest.approx(mine, rel=1e-6, abs=1e-7)
    assert {c for _, c in {(r.vec_id, r.component) for r in got}} == {1, 2, 3, 4, 5}


def test_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # no variance
    two = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in two) == [
        (1, 1, 2, 128 * 128, 1.0, 1.0), (2, 1, 2, 128 * 128, 1.0, 1.0)]
    far = whitening.whiten(spark.createDataFrame([(1, [1e30, 2.0]), (2, [-1e30, 2.0]), (3, [0.0, 1.0])], schema)).collect()
    assert {r.deviation for r in far if r.vec_id == 1} == {None}


def test_offset_costs_no_digits(spark):
    """Differences of one part in 10^6 of the entries decide everything."""
    rows = [(i, [(i % 5) / 64, ((i * i) % 7) / 64, (i % 3) / 64]) for i in range(1000)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = brute(rows, 3)
    of = dict(whole(rows))
    for r in got:
        n, deviation, z, _ = want[r.vec_id, tuple(of[r.vec_id])]
        assert r.deviation == deviation and abs(abs(r.whitened) - abs(z[r.component - 1])) < 1e-9
