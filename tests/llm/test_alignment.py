import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.dataset
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tonguemap.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(coders, text):
    """[(id, start, end)] of A and of B over the bytes of space and text, or nothing."""
    a, b = coders
    if not text:
        return [], []
    letters = alignment._byte_letters()
    sides = [
        [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids],
        [(i, alignment._b_bytes(b.id_to_piece(i))) for i in b.encode(text)],
    ]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in sides):
        return [], []
    out = []
    for side in sides:
        at, placed = 0, []
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def brute(coders, rows):
    each = []
    for i, text in rows:
        a, b = spans(coders, text)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, start = [], 0
        for end in ends:
            side = lambda s: ",".join(str(x) for x, f, e in s if start <= f and e <= end)  # noqa: B023, E731
            groups.append(f"{side(a)}|{side(b)}")
            start = end
        links = [(x, y) for x, f, e in a for y, g, h in b if f < h and g < e]
        each.append((i, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in each for p in links)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(n, highest.get(y, 0))
    return sorted(((
        i, n_a, n_b, len(groups), len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links),
        hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in each), key=str)


def given():
    rng = random.Random(21)
    bits = ["word", "tokenization", "naïve", "ﬁre", "½", "日本語", "🙂", "é", "́x", "'s", "don't", "<|endoftext|>", "</s>", "<0x41>", "12345",
            "", "", "\t", "\n", "a\nb", " ", " ", "\x1c", "\x00", "​", "...", "x" * 70, "Straße", "\r\n", "\x85"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "   "), (404, "a "), (405, " a"), (406, "a▁b"), (407, "y" * 3000), (408, "long text, " * 400)]
    return [*rows, (None, "no id"), (5, rows[5][1]), (5, rows[5][1]), (6, "another text of six")]


def test_alignment(spark, coders, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK", 500)  # several chunks in each task
    rows = given()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, chunk int, pair string")
    got = sorted((tuple(r) for r in alignment.align(docs, A, B, public_tokenizers.PATTERN).collect()), key=str)
    assert got == brute(coders, rows)
    assert {r[0] for r in got if r[1] == 0} >= {400, 401, 406}  # null, empty, and the text that B does not give back
    assert alignment.align(docs.limit(0), A, B, public_tokenizers.PATTERN).collect() == []
    none = alignment.align(docs.where("doc_id in (400, 401, 406)"), A, B, public_tokenizers.PATTERN).collect()
    assert [tuple(r)[1:] for r in none] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_chunks_are_written_in_small_parts(spark, coders, monkeypatch):
    """Rows of a chunk are large, so Parquet's hundred rows a page and row group would take the memory of an executor."""
    staged = {}
    stage = alignment.stage

    def noted(df, name, *options):
        staged[name] = stage(df, name, *options)
        return staged[name]

    monkeypatch.setattr(alignment, "stage", noted)
    monkeypatch.setattr(alignment, "CHUNK", 500)  # so each run of 64 texts is a chunk
    monkeypatch.setitem(alignment.IN_PARTS, "parquet.block.size", 20_000)
    rows = [(i, f"text {i} of some words, " * 8) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted((tuple(r) for r in alignment.align(docs, A, B, public_tokenizers.PATTERN).collect()), key=str) == brute(coders, rows)
    chunks = staged["aligned"]
    n = chunks.count()
    assert n == 25
    groups = [g.num_rows for f in chunks.inputFiles() for x in pa.dataset.dataset(f.removeprefix("file:")).get_fragments() for g in x.row_groups]
    assert sum(groups) == n and max(groups) < n / 2
    assert chunks.selectExpr("max(abs(length(which) - 2 * aggregate(n_links, 0L, (a, x) -> a + x)))").first()[0] == 0


def test_numbers_of_pairs_come_back():
    for distinct in (1, 1 << 16, (1 << 16) + 1):
        which = np.array([0, distinct - 1, distinct // 2], np.int32)
        packed = alignment._packed(which, distinct)
        assert len(packed) == 3 * (2 if distinct <= 1 << 16 else 4)
        assert alignment._unpacked(pa.scalar(packed, pa.binary()), distinct).tolist() == which.tolist()


def test_given_documents(spark, coders):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows = [r for r in rows if len(r[1]) < 3000]  # the brute force looks at all pairs of tokens
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted((tuple(r) for r in alignment.align(docs, A, B, public_tokenizers.PATTERN).collect()), key=str) == brute(coders, rows)


def split(ids, sizes):
    ends = [0, *sizes.cumsum().tolist()]
    return [ids[s:e].tolist() for s, e in zip(ends, ends[1:])]


def test_ids_are_those_of_the_library(spark, coders):
    """Over the given documents, and over letters, signs and blanks in any order."""
    known = alignment.Vocabularies(*alignment.read_a(A), open(B, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(22)
    bits = [*map(chr, range(1, 0x250)), "ing", "tion", " the", "  ", "é", "ß", "\n\n", "'ll", "###", "000", "<|endoftext|>", "</s>"]
    hostile = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(20_000)]
    texts = [t for _, t in given() if t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + hostile
    a, b, n_a, n_b = known.encode(texts)
    lost = 0
    for text, ids_a, ids_b in zip(texts, split(a, n_a), split(b, n_b)):
        if ids_a:
            assert [ids_a, ids_b] == [coders[0].encode(" " + text, add_special_tokens=False).ids, coders[1].encode(text)]
        lost += not ids_a
    assert lost == 1  # the text with U+2581
