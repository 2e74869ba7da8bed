import hashlib
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from tests.llm.test_pii import brute as brute_pii
from tests.llm.test_simhash import brute_fingerprint, brute_groups
from tonguemap.llm import bpe, mixing, toxicity
from tonguemap.operators.stage import stage

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def kept(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("given", docs)]
    for name, function in cp.STAGES:
        docs = stage(function(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def test_columns(steps):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "pii", "mixing", "bpe"]
    assert all(steps[n].columns == COLUMNS and steps[n].schema == steps["given"].schema for n in ("toxicity", "simhash", "pii", "mixing"))
    assert {"op%d" % n for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)}
    assert "pipeline" in entry.queries()


def test_toxicity(spark, steps):
    given, out = kept(steps["given"]), kept(steps["toxicity"])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(*toxicity.training_sample(steps["given"], labels))
    scorer = toxicity.Scorer(model)
    assert set(out) == {i for i, r in given.items() if scorer.score(r.text)[0] < 0.5}
    clean = {r.doc_id for r in labels.collect() if r.toxic == 0}
    assert len(clean & set(out)) >= 0.9 * len(clean & set(given))


def test_near_duplicates(steps):
    given, out = kept(steps["toxicity"]), kept(steps["simhash"])
    ids = sorted(given)
    root = brute_groups([brute_fingerprint(given[i].text) for i in ids])
    assert set(out) == {ids[i] for i in set(root)}
    assert all(out[i] == given[i] for i in out)


def test_personal_data(steps):
    given, out = kept(steps["simhash"]), kept(steps["pii"])
    assert set(given) == set(out)
    for i, r in given.items():
        if not re.search("[0-9@]", r.text):
            assert out[i] == r
        for kind, s, e in brute_pii(r.text):
            assert r.text[s:e] not in out[i].text and re.search("<(email|ip|card|phone)>", out[i].text)
        assert out[i].n_chars == len(out[i].text) or out[i] == r


def test_mixing(steps):
    plan = {r.doc_id: r.taken for r in mixing.mix(steps["pii"]).collect()}
    taken = {}
    for r in steps["mixing"].collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.encode().split())
    assert taken == {i: n for i, n in plan.items() if n}


def test_tokens(steps):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(P.path(cp.RANKS)))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in steps["bpe"].collect())
    want = sorted((r.doc_id, library.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps["mixing"].collect())
    assert got == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in steps["bpe"].collect())


def test_run_and_odd_rows(spark, steps, tmp_path):
    assert cp.run(spark, SF).count() == steps["bpe"].count()
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y", "en", None, 3), (None, "x y", "en", None, 3), (4, "é " * 60_000, "en", "a", 5), (5, "call a@b.cd now", "en", "b", 15), (5, "call a@b.cd now", "en", "b", 15)]
    docs = spark.createDataFrame(odd, steps["given"].schema).withColumn("rank", F.lit(1))
    for name, function in cp.STAGES:
        docs = stage(function(spark, docs, SF), name)
    texts = {r.doc_id for r in docs.collect()}
    assert texts <= {None, 4, 5}
    nothing = steps["given"].limit(0)
    for name, function in cp.STAGES:
        nothing = stage(function(spark, nothing, SF), name)
    assert nothing.count() == 0
