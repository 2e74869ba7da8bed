import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonguemap.llm import toxicity

BAD = "rotten vile nasty".split()


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(900):
        said = [rng.choices(words, k=rng.randrange(3, 12)) for _ in range(rng.randrange(2, 25))]
        toxic = i % 4 == 0
        if toxic:
            rng.choice(said).append(rng.choice(BAD))
        docs.append((i, "\n".join(" ".join(s) + "." for s in said), "x"))
        if i % 10 != 9:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None, "x"), (2001, "", "x"), (2002, "?!", "x"), (2003, " ".join(rng.choices(words, k=60_000)), "x"), (2004, docs[0][1], "x"), (None, "w1 vile.", "x"), (2003, "w5 vile w6 w7. w8", "x")]
    labels += [(3000, 1, 1), (None, 0, 1), (5, 0, None), (8, 1, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs)


def test_scores(data):
    docs, labels, rows = data
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, i): r for i, r in enumerate(sorted(out, key=lambda r: (r.doc_id or 0, r.score)))}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    right = np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held])
    assert len(held) > 100 and right > 0.97
    text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] < 900}
    for r in out:
        if r.predicted and r.doc_id is not None and r.doc_id < 900:
            said = [text[r.doc_id][s.start : s.end] for s in r.toxic_sentences]
            assert any(b in s for s in said for b in BAD) or not said
    assert all(r.score == 0 for r in out if r.doc_id in (2000, 2001, 2002))
    assert got
    again = {(r.doc_id, r.score) for r in toxicity.toxicity(docs.repartition(5), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in out}


def test_labels_of_held_out_rows_do_not_matter(data, spark):
    docs, labels, rows = data
    held = [r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    flipped = labels.rdd.map(lambda r: (r.doc_id, r.quality, 1 - r.toxic if r.doc_id in held and r.toxic is not None else r.toxic))
    a = toxicity.training_sample(docs, labels)
    b = toxicity.training_sample(docs, spark.createDataFrame(flipped.collect(), labels.schema))
    assert a == b
    texts, _ = toxicity.training_sample(docs, labels, per_class=10)
    assert len(texts) == 20


def test_clean(data):
    docs, labels, rows = data
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    ids = {(r.doc_id, r.text) for r in kept.collect()}
    assert {(2000, None), (2001, ""), (2002, "?!")} <= ids and len([1 for i, _ in ids if i == 2003]) == 1
    assert (None, "w1 vile.") not in ids
    clean = [r for r in rows if r[0] is not None and r[0] < 900 and r[0] % 4]
    assert sum((r[0], r[1]) in ids for r in clean) >= 0.98 * len(clean)


def test_nothing_to_learn_from(data):
    docs, labels, rows = data
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_gradient_finds_the_words():
    model = toxicity.fit(["good day. bad thing.", "good day. fine thing.", "bad bad. good", "fine day"], [1, 0, 1, 0], min_docs=1)
    scorer = toxicity.Scorer(model)
    score, spans = scorer.score("good fine day. bad thing. good")
    assert score > 0.5 and [(s, e) for s, e, _ in spans] == [(15, 24)]
    assert scorer.score("good fine day.")[0] < 0.5


def plain_score(model, text):
    """The noisy-or as it is defined: one minus the product of what each sentence leaves."""
    left, spans, at = 1.0, [], 0
    pieces = re.split(r"([.!?]+\s|\n)", text.lower())
    for piece, end in zip(pieces[::2], [*pieces[1::2], ""]):
        words = set(re.findall(r"\w+", piece))
        if words:
            z = model.bias + sum(float(model.weights[f]) for w in words for f in toxicity.features(w))
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
            left *= 1 - p
            if p >= 0.5:
                spans.append((at, at + len(piece)))
        at += len(piece) + len(end)
    return 1 - left, spans


def test_scores_are_the_noisy_or(data, spark):
    docs, labels, rows = data
    model = toxicity.fit(*toxicity.training_sample(docs, labels))
    got = {(r.doc_id, r.score): r for r in toxicity.score(docs, model).collect()}
    found = 0
    for i, text, _ in rows:
        score, spans = plain_score(model, text or "")
        near = [r for (d, s), r in got.items() if d == i and s == pytest.approx(score, rel=1e-6, abs=1e-9)]
        assert near, (i, score)
        assert any([(x.start, x.end) for x in r.toxic_sentences] == spans for r in near)
        found += len(spans)
    assert found > 100


def test_a_repeated_labelled_id_is_one_training_row(data, spark):
    docs, labels, _ = data
    hot = docs.where("doc_id = 4").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50_000)))).drop("n")
    texts, y = toxicity.training_sample(docs.unionByName(hot), labels)
    assert (texts, y) == toxicity.training_sample(docs, labels) and len(texts) <= 2 * toxicity.SAMPLE
    other = spark.createDataFrame([(4, f"text {i}", "x") for i in range(100)], docs.schema)
    assert len(toxicity.training_sample(docs.unionByName(other), labels)[0]) == len(texts)
