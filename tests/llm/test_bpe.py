import hashlib

import public_tokenizers as P
import pyarrow as pa
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tonguemap.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
TOKENS = bpe.read_ranks(RANKS)
CODEC = bpe.Encoder(bpe.model_proto(TOKENS), P.PATTERN)
BY_ID = pa.array(TOKENS, pa.large_binary())
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})


def test_every_token_encodes_to_itself():
    ids = CODEC.model.encode([bpe.letters(t) for t in TOKENS])
    assert ids == [[i + 1] for i in range(len(TOKENS))]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert bpe.joined(BY_ID, pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [text.encode()]


def test_lists_of_a_run(spark):
    lists = [[64], None, [], [0, 64, 300], [], [220] * 5, None]
    want = [b"".join(TOKENS[i] for i in x or []) for x in lists]
    whole = pa.array(lists, pa.list_(pa.int32()))
    assert bpe.joined(BY_ID, whole).to_pylist() == want
    assert bpe.joined(BY_ID, whole.slice(2, 4)).to_pylist() == want[2:6]
    assert bpe.joined(BY_ID, whole.slice(1, 2)).to_pylist() == [b"", b""]
    got = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>"), RANKS).orderBy("i").collect()
    assert [bytes(r.decoded) for r in got] == want


def test_query_on_odd_rows(spark, monkeypatch):
    texts = [None, "", "a", "a", "<|endoftext|> </s>", "héllo   wörld\n\n 12345 don't", "x" * 50_000, "é中文😀 " * 3_000]
    docs = spark.createDataFrame([(i % 3, t, "own") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(tuple(r) for r in bpe.digests(docs, RANKS, P.PATTERN).collect())
    want = []
    for i, t in enumerate(texts):
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i % 3, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    kept = bpe.encode(docs, RANKS, P.PATTERN)
    assert kept.columns == ["doc_id", "text", "ids"]


def test_texts_and_ids_go_to_python_once(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")
    coded = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS)
    got = [(r.text, list(r.ids), bytes(r.decoded)) for r in coded.orderBy("doc_id").collect()]
    assert got == [(None, [], b""), ("a b", LIBRARY.encode_ordinary("a b"), b"a b")]
    decoding = coded._jdf.queryExecution().analyzed()
    given = decoding.children().apply(0)
    assert [given.output().size(), given.children().apply(0).children().apply(0).output().size()] == [3, 2]
