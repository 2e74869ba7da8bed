"""Toxicity of documents and of their sentences, learned from document labels alone.

Multiple-instance learning: a document is a bag of sentences, each sentence gets a probability from the
set of its words, and the document's is their noisy-or, 1 - prod(1 - p). The weights maximise the likelihood of
the document labels, so no sentence is ever labelled, yet the sentences that make a document toxic
come out of it.

Training takes at most ``SAMPLE`` documents of each class, those with the smallest hashes of their ids,
none longer than ``SAMPLE_CHARS`` characters, and one text of each id: the bound on what reaches the driver. Each word has three
features, itself and its first four and five letters, hashed to ``BUCKETS`` weights, so the model that
goes to the tasks is of fixed size. Scoring reads every whole text once, without a shuffle.

Null and empty texts have no sentence and get the score 0 (the noisy-or of nothing), predicted 0. Repeated
rows are scored alike. Labels that are null or of no document are passed over; of several labels of an
id the highest holds. Where a class has no training document, every sentence has the score 0.
An empty table gives an empty result. Further columns are ignored by scores and kept by :func:`clean`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.llm.common import fold, slices

SAMPLE = 3000
SAMPLE_CHARS = 30_000
BUCKETS = 1 << 18
ROUNDS = 200
RATE = 0.15
DECAY = 1e-4  # of squared weights
SPARSE = 1e-4  # of absolute weights
MIN_DOCS = 30  # training documents that a feature must be in
TOXIC_SHARE = 0.1  # weight of the toxic class in the likelihood: about its share of a corpus
START_BIAS = -5.0
MAX_CACHED = 100_000
SEED = 1

SENTENCE = re.compile(r"[.!?]+\s|\n")
TOKEN = re.compile(r"\w+")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each piece between sentence ends that has a word; code points."""
    out, start = [], 0
    for m in SENTENCE.finditer(text):
        if not text[start : m.start()].isspace() and start < m.start():
            out.append((start, m.start()))
        start = m.end()
    if start < len(text) and not text[start:].isspace():
        out.append((start, len(text)))
    return out


def features(word: str) -> tuple[int, int, int]:
    """Weight numbers of a lower-case word, of its first four, and of its first five letters."""
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in (word, "4" + word[:4], "5" + word[:5]))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def fit(texts: list[str], labels: list[int], min_docs: int = MIN_DOCS) -> Model:
    """Full-batch Adam on the noisy-or likelihood. Features of few documents, which could only be learnt by heart, are left out."""
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), -np.inf)
    number: dict[str, int] = {}
    tokens, per_sentence, per_doc = [], [], []
    for text in texts:
        n = 0
        for s, e in sentences(text.lower()):
            found = [number.setdefault(w, len(number)) for w in dict.fromkeys(TOKEN.findall(text[s:e].lower()))]
            if found:
                tokens.append(np.array(found, np.int32))
                per_sentence.append(len(found))
                n += 1
        per_doc.append(n)
    full = np.array(per_doc) > 0
    y, per_doc = y[full], np.array(per_doc)[full]
    token = np.concatenate(tokens)
    sentence_at = np.concatenate([[0], np.cumsum(per_sentence)[:-1]])
    sentence_of = np.repeat(np.arange(len(per_sentence)), per_sentence)
    doc_at, doc_of = np.concatenate([[0], np.cumsum(per_doc)[:-1]]), np.repeat(np.arange(len(per_doc)), per_doc)
    parts = np.array([features(w) for w in number], np.int64)
    in_docs = np.bincount(np.unique(np.stack([doc_of[sentence_of], token]), axis=1)[1], minlength=len(parts))
    usual = sum(np.bincount(parts[:, i], in_docs, BUCKETS) for i in range(3)) >= min_docs
    share = np.where(y == 1, TOXIC_SHARE / max(1, (y == 1).sum()), (1 - TOXIC_SHARE) / max(1, (y == 0).sum()))
    w, bias = np.zeros(BUCKETS), START_BIAS
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, ROUNDS + 1):
        z = np.add.reduceat(w[parts].sum(1)[token], sentence_at) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-12)), doc_at)  # log of prod(1 - p)
        clean = np.minimum(np.exp(none), 1 - 1e-12)
        # d log L / d z of a sentence: -p where the label is 0, p * prod(1 - p) / (1 - prod(1 - p)) where it is 1
        slope = np.where(y == 1, clean / (1 - clean), -1.0) * share
        gz = slope[doc_of] * p
        word = np.bincount(token, gz[sentence_of], len(parts))
        g = sum(np.bincount(parts[:, i], word, BUCKETS) for i in range(3)) - DECAY * w - SPARSE * np.sign(w)
        g *= usual
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gz.sum(), 0.999 * vb + 0.001 * gz.sum() ** 2
        step = RATE / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
        w = w + step * m / (np.sqrt(v) + 1e-9)
        bias += step * mb / (np.sqrt(vb) + 1e-9)
    return Model(w.astype(np.float32), float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[list[str], list[int]]:
    """Texts and labels for training, a bounded number, the same on every run."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = docs.where(fold(F.col("doc_id"), 5) != 0).where(F.char_length("text") <= SAMPLE_CHARS)
    usable = own.select("doc_id").join(known, "doc_id").distinct()
    order = F.xxhash64(F.lit(SEED), "doc_id")
    pick = [usable.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    chosen = pick[0].unionByName(pick[1])
    # at most 2 * per_class ids, so sending them to every task is bounded; an id that many rows have is one of them
    texts = own.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("toxic").alias("toxic"))
    rows = sorted(one.select("doc_id", "t.text", "toxic").collect())
    return [r.text for r in rows], [int(r.toxic) for r in rows]


class Scorer:
    """Sentence probabilities of a model, with a bounded memory of word weights."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def _weight(self, word: str) -> float:
        weight = float(sum(float(self.model.weights[f]) for f in features(word)))
        if len(self.known) >= MAX_CACHED:
            self.known.clear()
        self.known[word] = weight
        return weight

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and (start, end, p) of those with p >= 0.5."""
        lower = text.lower() if len(text.lower()) == len(text) else text.translate(_ASCII)
        known, bias = self.known, self.model.bias
        spans, logits = [], []
        for s, e in sentences(lower):
            words = dict.fromkeys(TOKEN.findall(lower, s, e))
            if words:
                z = bias
                for w in words:
                    x = known.get(w)
                    z += self._weight(w) if x is None else x
                spans.append((s, e))
                logits.append(z)
        if not spans:
            return 0.0, []
        p = 1 / (1 + np.exp(-np.clip(logits, -30.0, 30.0)))
        if np.isneginf(bias):
            p = np.zeros(len(spans))
        score = float(-np.expm1(np.log1p(-p).sum()))
        return score, [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


_ASCII = {i: i + 32 for i in range(65, 91)}


@lru_cache(maxsize=2)
def _scorer(packed: bytes, bias: float) -> Scorer:
    return Scorer(Model(np.frombuffer(packed, np.float32), bias))


SCORED = "doc_id {}, score double, predicted int, toxic_sentences array<struct<start:int,end:int,p:double>>"


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: doc_id, score, predicted and the offending sentences as code point spans."""
    packed = docs.sparkSession.sparkContext.broadcast(model.weights.astype(np.float32).tobytes())
    bias = model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(packed.value, bias)
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for batch in slices(batches):
            found = [scorer.score(t) for t in batch.column(1).to_pylist()]
            scores = np.array([f[0] for f in found])
            where = [[{"start": s, "end": e, "p": p} for s, e, p in f[1]] for f in found]
            columns = [batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(where, spans)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "toxic_sentences"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return given.mapInArrow(run, SCORED.format(given.schema["doc_id"].dataType.simpleString()))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labelled documents that are not held out, and score all: doc_id, held_out, score, predicted, …"""
    scored = score(docs, fit(*training_sample(docs, labels)))
    return scored.withColumn("held_out", fold(F.col("doc_id"), 5) == 0).select(
        "doc_id", "held_out", "score", "predicted", "toxic_sentences")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted toxic, with all its columns.

    The verdict is joined by id and text hash, so a row goes by its own text even where ids repeat.
    """
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("text").alias("h")))
    bad = score(keyed, fit(*training_sample(docs, labels)), doc_id="_key").where("predicted = 1")
    bad = bad.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.h").alias("_h")).distinct()
    same = F.col("_key.doc_id").eqNullSafe(F.col("_id")) & F.col("_key.h").eqNullSafe(F.col("_h"))
    return keyed.join(bad, same, "left_anti").drop("_key")
