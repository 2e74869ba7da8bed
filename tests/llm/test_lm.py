import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tonguemap.llm import lm

D = lm.DISCOUNT


def tokens(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in text.split(" ") if w] + ["</end>"]


class Brute:
    """The same model, by recursion over counts."""

    def __init__(self, texts, least):
        said = [tokens(t) for t in texts]
        self.uni = Counter(w for s in said for w in s)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        ok = {w for w, c in self.uni.items() if c >= least} | {"</end>"}
        two = Counter(p for s in said for p in zip(["<begin>", *s], s) if set(p) <= ok | {"<begin>"})
        self.two = {p: c for p, c in two.items() if c >= least}
        three = Counter(p for s in said for p in zip(["<begin>", *s], s, s[1:]) if p[:2] in self.two and p[1:] in self.two)
        self.three = {p: c for p, c in three.items() if c >= least}
        self.history = self.uni | {"<begin>": len(said)}

    def p(self, w, h):
        if not h:
            return (self.uni.get(w, 0) + 0.1) / (self.n + 0.1 * (self.v + 1))
        table, whole = (self.two, self.history.get(h[0], 0)) if len(h) == 1 else (self.three, self.two.get(h, 0))
        arcs = [k[-1] for k in table if k[:-1] == h]
        if w in arcs:
            return (table[(*h, w)] - D) / whole
        left = 1 - sum((table[(*h, x)] - D) / whole for x in arcs)
        return left / (1 - sum(self.p(x, h[1:]) for x in arcs)) * self.p(w, h[1:])

    def score(self, text):
        out, h = 0.0, ("<begin>",)
        for w in tokens(text):
            out += math.log10(self.p(w, h))
            h = (*h, w)[-2:]
            if h not in self.two:
                h = h[-1:]
        return out

    def base(self, text):
        return sum(math.log10(self.p(w, ())) for w in tokens(text))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    words = [f"W{i}é" for i in range(40)]
    out = []
    for i in range(150):
        t, at = [], rng.randrange(40)
        for _ in range(rng.randrange(30)):
            at = (at * 3 + 1) % 40 if rng.random() < 0.7 else rng.randrange(40)
            t.append(words[at] if rng.random() < 0.9 else f"rare{rng.randrange(200)}")
        out.append((i, rng.choice([" ", "\n", "\t "]).join(t)))
    return [*out, (200, None), (201, ""), (202, "x" * 100_000), (203, "a b\x1fc " * 20_000), (5, out[5][1]), (None, "lost W1é w1é")]


def held(i):
    return zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0


def test_scores(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    training = [t for i, t in rows if not held(i)]
    n = sum(len(tokens(t)) for t in training)
    for span in (lm.CHUNK, 300):  # a chunk for each task, and many of them
        monkeypatch.setattr(lm, "CHUNK", span)
        brute = Brute(training, lm.LEAST)
        got = lm.score(docs).collect()
        assert len(got) == len(rows)
        want = sorted(((i, t) for i, t in rows), key=str)
        for r, (i, t) in zip(sorted(got, key=lambda r: str((r.doc_id, dict(rows).get(r.doc_id)))), sorted(want, key=lambda x: str((x[0], dict(rows).get(x[0]))))):
            assert (r.doc_id, r.held_out, r.n_tokens, r.train_tokens) == (i, held(i), len(tokens(t)), n)
            assert r.n_known == sum(w in brute.uni for w in tokens(t))
            assert r.base_score == pytest.approx(brute.base(t), rel=1e-9)
            if len(tokens(t)) < 1000:
                assert r.score == pytest.approx(brute.score(t), rel=1e-9), (i, span)
    out = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    for h in [(), ("<begin>",), ("w1é",), next(iter(brute.three))[:2]]:
        assert sum(brute.p(w, h) for w in [*brute.uni, "unseen"]) == pytest.approx(1)


def test_no_rows_and_no_training(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.score(docs.limit(0)).count() == 0
    first = next(i for i, _ in rows if held(i))
    only = lm.score(docs.where(f"doc_id = {first}")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score, r.score) for r in only] == [(0, 0, 0.0, 0.0)]


def test_large_corpora_keep_what_is_seen_twice(spark):
    ids = iter(i for i in range(1000) if not held(i))
    said = ["one two three four"] * 2 + ["one two three five", *["six seven"] * 3, "x y " * 1_300_000]
    rows = [(next(ids), t) for t in said] + [(next(i for i in range(1000) if held(i)), "zero one two three four")]
    brute = Brute([t for i, t in rows if not held(i)], 2)
    for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r.n_tokens < 1000:
            assert r.score == pytest.approx(brute.score(dict(rows)[r.doc_id]), rel=1e-9)


def test_rows_grow_with_the_keys(spark, monkeypatch):
    """Chunks and parts of keys grow together, so no exchange has more rows than one for some keys."""
    for size in (10**6, 10**9, 3 * 10**10, 10**12, 10**14):
        m = lm.Model.of(size)
        chunks = size / lm.WORD_BYTES / m.span
        assert chunks * (1 << m.bits) <= 4 * max(size / lm.WORD_BYTES / lm.RUN, 16)
        assert m.span == lm.CHUNK or m.span <= 40_000_000


def test_texts_are_not_moved(spark, rows):
    """Chunks and replies lie in the same buckets, so joining them needs no exchange."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lm.score(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("SortMergeJoin") == 3 and "Exchange" not in plan


@pytest.mark.parametrize("n, distinct", [(0, 1), (1, 1), (1000, 1), (5000, 70), (5000, 1 << 62)])
def test_distinct_keys(n, distinct):
    keys = np.random.default_rng(n).integers(0, distinct, n).astype(np.uint64) << np.uint64(2)
    values, one, inverse = lm._distinct(keys)
    want, places = np.unique(keys, return_inverse=True)
    assert (values == want).all() and (keys[one] == want).all() and (inverse == places).all()
    assert len(values) == len(one) == len(want) and len(inverse) == n
