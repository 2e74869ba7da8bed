"""Language model scores of texts by a weighted backoff automaton.

A state is a history of up to two words, an arc reads a word and adds its log probability, and a failure
arc drops the oldest word of the history and adds its backoff weight. All words have arcs, and all pairs
and triples that training texts hold ``LEAST`` times or more, a floor that is the same at every size.
Nothing of the model is gathered on the driver or broadcast.

Texts are read once into chunks: word hashes and the words by number. What a chunk needs of the corpus it asks for
by 64-bit hashes: each chunk sends its distinct keys with its own counts, cut by the leading bits of the key, to
the tasks that hold these keys, which add them up and send the totals back (``_exchange``). A key comes once from
a chunk at most, so none is hot. One of the chunks that ask for a key is told that it owns it, and adds its arc
to the sums of its history. Chunks and what came back to them are tables bucketed by chunk, so that they are joined
where they lie, and texts are never moved.

1. Counts of words and pairs.
2. Counts of triples both pairs of which are kept (others can't reach the floor), and per word the number and the
   counts of its arcs, and of the words that these read.
3. The same per pair that is a history, where a text fails from it or an arc is owned.
4. Each chunk has the arcs and backoff weights of all its histories. All its texts are read from left to right, a word of
   each at a time, each with its state and the sum so far.

Chunks, and the parts that keys are cut into, hold ``CHUNK`` tokens, or more in corpora of over some 16 billion tokens: then
both grow with the square root of the corpus, so that a row holds ``RUN`` keys at least on average and rows grow in
proportion to the distinct n-grams of the chunks (a corpus of 100 TB takes chunks of some 30 million tokens, 3 GB of a task).

Probabilities: unigrams are (c + 0.1) / (N + 0.1 (V + 1)), where the one in V + 1 is a word never seen.
Longer histories give (c - D) / c(history) to the words of their arcs, and what is left to the shorter
history, scaled so that everything sums to one.

Nulls count as empty texts, whose only token is the end. Repeated rows are scored each and, in training,
counted each; null ids count as empty text when they are dealt to folds. Without training texts every token has the
probability 1 (0.1 / 0.1); an empty table gives an empty result. Texts of any length are read whole, as a stream of
words; further columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.llm.common import fold, slices, utf8
from tonguemap.operators.stage import new_path

FOLDS = 10  # one in so many texts is held out
LEAST = 2  # occurrences of a kept pair or triple
DISCOUNT = 0.6
PSEUDO = 0.1
END = b""  # no word is empty
CHUNK = 1_000_000  # tokens
RUN = 64  # keys of a row, at least on average
WORD_BYTES = 6  # of a text for each word, roughly
SENT = "bucket int, chunk long, kind int, types long, blob binary"
WORD, PAIR, AFTER_WORD, TRIPLE, AFTER_PAIR = range(5)  # kinds of keys

_END, _BEGIN = 0, 1  # numbers in every chunk
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Model:
    """What all chunks know."""

    span: int  # tokens of a chunk
    bits: int  # leading bits of a key that name the part it goes to
    tokens: int = 0
    types: int = 0

    @staticmethod
    def of(size: int) -> Model:
        """For texts of ``size`` bytes."""
        tokens = max(1, size // WORD_BYTES)
        span = max(CHUNK, math.isqrt(RUN * tokens))
        return Model(span, max(4, math.ceil(math.log2(2 * tokens / span))))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, those of numbers byte by byte of their places."""
    out = []
    for x in arrays:
        raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
        part = pa.compress(raw, codec="zstd", asbytes=True)
        head = f"{x.dtype.str},{len(x)},{len(part)};".encode()
        out += [head, part]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        stop = blob.index(b";", at)
        kind, n, size = blob[at:stop].decode().split(",")
        dtype, n, at = np.dtype(kind), int(n), stop + 1
        raw = pa.decompress(blob[at : at + int(size)], n * dtype.itemsize, codec="zstd", asbytes=True)
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += int(size)
    return out


class _Numbers(dict):
    """Numbers of words in the order they come in."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _chunks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    first, made = TaskContext.get().partitionId() << 32, 0
    names = ["chunk", "tokens", "ids", "blob"]
    ids, texts, train = [], [], []
    numbers = _Numbers({END: _END, None: _BEGIN})

    def out() -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w or b"", w is None) for w in numbers), np.uint64, len(numbers))
        sizes = np.fromiter(map(len, texts), np.int32, len(texts))
        used = np.concatenate(train)
        blob = _pack(hashes, np.concatenate(texts), sizes, used.view(np.uint8))
        docs = pa.concat_arrays(ids)
        lists = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        n = int((sizes - 1)[used].sum())
        return pa.RecordBatch.from_arrays([pa.array([first + made]), pa.array([n]), lists, pa.array([blob], pa.binary())], names=names)

    held = 0
    for batch in slices(batches, 32):
        ids.append(batch.column(0))
        train.append(~batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
        for text in batch.column(1).to_pylist():
            words = text.lower().split()
            x = np.empty(len(words) + 2, np.int32)
            x[0], x[-1] = _BEGIN, _END
            x[1:-1] = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
            texts.append(x)
            held += len(x)
        if held > span:
            yield out()
            made, held = made + 1, 0
            ids, texts, train = [], [], []
            numbers = _Numbers({END: _END, None: _BEGIN})
    if ids:
        yield out()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + b
    x = (x ^ (x >> np.uint64(31))) * _B  # the order of the two counts
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and per key its number, as ``np.unique`` says them; any place will do, so the
    sort need not be a stable one, which takes three times as long."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


class _Texts:
    """The texts of a chunk, with what has come back to it."""

    def __init__(self, chunk: int, blob: bytes, replies: list[dict], model: Model):
        self.chunk, self.model = chunk, model
        self.replies: dict[int, list[bytes]] = {}
        for r in sorted(replies or [], key=lambda r: (r["kind"], r["bucket"])):
            self.replies.setdefault(r["kind"], []).append(r["blob"])
        self.hashes, x, self.sizes, train = _unpack(blob)
        self.at = np.flatnonzero(x != _BEGIN)  # places that are read; before each is its history
        self.word, self.last = x[self.at], x[self.at - 1]
        self.train = np.repeat(train.astype(np.float64), self.sizes)[self.at]
        self.word_order = np.argsort(self.hashes)
        keys = _mix(self.hashes[self.last], self.hashes[self.word])
        self.pairs, one, self.pair = _distinct(keys)
        self.pair_last, self.pair_word = self.last[one], self.word[one]

    def reply(self, kind: int, n: int) -> list[np.ndarray]:
        """What came back for the keys that were sent, in their order."""
        parts = [_unpack(blob) for blob in self.replies.get(kind, [])]
        return [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0)] * n

    def load_counts(self) -> None:
        self.c1 = np.zeros(len(self.hashes), np.int64)
        self.c1[self.word_order] = self.reply(WORD, 2)[0]
        self.base = np.log10((self.c1 + PSEUDO) / self.whole)
        self.history = self.c1.copy()
        self.history[_BEGIN] = self.c1[_END]  # the begin is as frequent as the end
        self.c2, own = self.reply(PAIR, 2)
        self.own_pair = own.astype(bool)
        self.kept = self.c2 >= LEAST
        self.p2 = np.where(self.kept, (self.c2 - DISCOUNT) / np.maximum(self.history[self.pair_last], 1), 1.0)
        self.before = np.append(-1, self.pair[:-1])  # the pair that ends in the last word
        self.before[self.last == _BEGIN] = -1
        self.in_pair = (self.before >= 0) & self.kept[self.before]
        self.both = np.flatnonzero(self.in_pair & self.kept[self.pair])
        keys = _mix(self.pairs[self.before[self.both]], self.pairs[self.pair[self.both]])
        self.triples, one, self.triple = _distinct(keys)
        self.first, self.second = self.before[self.both][one], self.pair[self.both][one]
        self.frequent = self.word_order[self.history[self.word_order] >= LEAST]  # other words have no arcs

    def load_triples(self) -> None:
        self.c3, own = self.reply(TRIPLE, 2)
        self.own_triple = own.astype(bool)
        self.kept3 = self.c3 >= LEAST
        self.p3 = np.where(self.kept3, (self.c3 - DISCOUNT) / np.maximum(self.c2[self.first], 1), 1.0)
        # histories whose weight is asked for, or that an owned arc adds to
        fails = self.in_pair.copy()
        fails[self.both[self.kept3[self.triple]]] = False
        asked = np.zeros(len(self.pairs), bool)
        asked[self.before[fails]] = True
        asked[self.first[self.kept3 & self.own_triple]] = True
        self.asked = np.flatnonzero(asked)

    @property
    def whole(self) -> float:
        return self.model.tokens + PSEUDO * (self.model.types + 1)


Asked = Iterator[tuple[int, np.ndarray, list[np.ndarray]]]  # kind, keys in order, whole numbers that add up


def _sums(history: np.ndarray, n: int, *values: np.ndarray) -> list[np.ndarray]:
    """Number of arcs per history, and sums of their values."""
    return [np.bincount(history, minlength=n), *(np.bincount(history, v, n).astype(np.int64) for v in values)]


def _ask_counts(t: _Texts) -> Asked:
    yield WORD, t.hashes[t.word_order], [np.bincount(t.word, t.train, len(t.hashes)).astype(np.int64)[t.word_order]]
    yield PAIR, t.pairs, [np.bincount(t.pair, t.train, len(t.pairs)).astype(np.int64)]


def _ask_triples(t: _Texts) -> Asked:
    t.load_counts()
    mine = t.kept & t.own_pair
    sums = _sums(t.pair_last[mine], len(t.hashes), t.c2[mine], t.c1[t.pair_word[mine]])
    yield AFTER_WORD, t.hashes[t.frequent], [x[t.frequent] for x in sums]
    yield TRIPLE, t.triples, [np.bincount(t.triple, t.train[t.both], len(t.triples)).astype(np.int64)]


def _ask_histories(t: _Texts) -> Asked:
    t.load_counts()
    t.load_triples()
    mine = t.kept3 & t.own_triple
    sums = _sums(t.first[mine], len(t.pairs), t.c3[mine], t.c2[t.second[mine]])
    yield AFTER_PAIR, t.pairs[t.asked], [x[t.asked] for x in sums]


def _added(kind: int, keys: np.ndarray, values: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Per key as it was sent: what the chunk gets to know; and the number of distinct words in training texts."""
    distinct, one, inverse = _distinct(keys)
    sums = [np.bincount(inverse, v, len(distinct)).astype(np.int64) for v in values]
    if kind in (AFTER_WORD, AFTER_PAIR):
        return [s[inverse] for s in sums], 0
    own = np.zeros(len(keys), np.uint8)
    own[one] = 1
    return [sums[0][inverse], own], int((sums[0] > 0).sum()) if kind == WORD else 0


def _backoff(arcs: np.ndarray, counts: np.ndarray, whole: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of what the arcs of each history leave, over what the shorter history gives to other words."""
    left = 1 - (counts - DISCOUNT * arcs) / np.maximum(whole, 1)
    return np.log10(np.maximum(left, 1e-12) / np.maximum(1 - lower, 1e-12))


def _read(t: _Texts) -> list[np.ndarray]:
    """Per text of the chunk: tokens, known ones, and the sums along its path through the automaton."""
    t.load_counts()
    t.load_triples()
    weight1, weight2 = np.zeros(len(t.hashes)), np.zeros(len(t.pairs))
    arcs, counts, read = t.reply(AFTER_WORD, 3)
    weight1[t.frequent] = _backoff(arcs, counts, t.history[t.frequent], (read + PSEUDO * arcs) / t.whole)
    arcs, counts, read = t.reply(AFTER_PAIR, 3)
    lower = (read - DISCOUNT * arcs) / np.maximum(t.history[t.pair_word[t.asked]], 1)
    weight2[t.asked] = _backoff(arcs, counts, t.c2[t.asked], lower)
    base = t.base[t.word]
    n = t.sizes - 1
    starts = np.cumsum(n) - n
    # arcs that leave the state of the last word, and those that leave the state of the last pair (or none, -1)
    arc1 = np.where(t.kept[t.pair], np.log10(t.p2)[t.pair], np.nan)
    arc2 = np.full(len(t.word), np.nan)
    arc2[t.both] = np.where(t.kept3, np.log10(t.p3), np.nan)[t.triple]
    to = np.where(t.kept[t.pair], t.pair, -1)
    order = np.argsort(-n, kind="stable")
    place, left = starts[order], n[order]
    state, score = np.full(len(n), -1), np.zeros(len(n))
    running = len(n)
    for step in range(int(left[0])):
        running = int(np.searchsorted(-left[:running], -step))  # texts with more words than that
        at, s = place[:running] + step, state[:running]
        direct = np.where(s >= 0, arc2[at], np.nan)
        fails = np.where(s >= 0, weight2[s], 0.0)
        word = arc1[at]
        shorter = np.where(np.isnan(word), weight1[t.last[at]] + base[at], word)
        score[:running] += np.where(np.isnan(direct), fails + shorter, direct)
        state[:running] = to[at]
    said = np.zeros(len(n))
    said[order] = score
    known = np.add.reduceat((t.c1[t.word] > 0).astype(np.int64), starts)
    return [n.astype(np.int64), known, np.add.reduceat(base, starts), said]


def _each(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[_Texts]:
    """One chunk after the other."""
    for batch in slices(batches, 1):
        row = batch.to_pylist()[0]
        yield _Texts(row["chunk"], row["blob"], row["replies"], model)


def _exchange(rows: DataFrame, ask: Callable[[_Texts], Asked], model: Model, name: str) -> DataFrame:
    """What the keys that ``ask`` gives for each chunk add up to: a row per chunk, with the list of its replies."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.arange(1, 1 << model.bits, dtype=np.uint64) << np.uint64(64 - model.bits)
        for texts in _each(batches, model):
            out = []
            for kind, keys, values in ask(texts):
                ends = [0, *np.searchsorted(keys, cuts).tolist(), len(keys)]
                for bucket, (s, e) in enumerate(zip(ends, ends[1:])):
                    if s < e:
                        steps = np.diff(keys[s:e], prepend=np.uint64(0))
                        out.append((bucket, texts.chunk, kind, 0, _pack(steps, *[v[s:e] for v in values])))
            yield from _table(out).to_batches()

    def add(table: pa.Table) -> pa.Table:
        chunks, kind, bucket = table.column("chunk").to_pylist(), table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        sent = [_unpack(b) for b in table.column("blob").to_pylist()]
        keys = np.concatenate([np.cumsum(s[0]) for s in sent])
        answers, types = _added(kind, keys, [np.concatenate(v) for v in zip(*(s[1:] for s in sent))])
        ends = np.cumsum([0, *(len(s[0]) for s in sent)])
        return _table([
            (bucket, chunk, kind, types if i == 0 else 0, _pack(*[x[ends[i] : ends[i + 1]] for x in answers]))
            for i, chunk in enumerate(chunks)])

    added = rows.mapInArrow(send, SENT).groupBy("kind", "bucket").applyInArrow(add, SENT)
    # a chunk's own keys come back to it, so the list is as bounded as the chunk
    each = added.groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "blob")).alias("replies"), F.sum("types").alias("types"))
    return _bucketed(each, name, model)


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in SENT.split(", ")])


def _bucketed(df: DataFrame, name: str, model: Model) -> DataFrame:
    """Write a table bucketed by chunk, so that it is joined by chunk where it lies."""
    buckets = 1 << (model.bits - 1)  # about as many as there are chunks
    spark, table = df.sparkSession, f"tonguemap_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "chunk").option("path", new_path(spark, name)).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name only: the files stay, as of all staged tables
    return out


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Train on the texts that are not held out, and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row.
    """
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    given = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("t")).withColumn("held", held_out)
    model = Model.of(int(given.agg(F.sum(F.octet_length("t") + WORD_BYTES)).first()[0] or 0))
    kind = given.schema["doc_id"].dataType.simpleString()
    cut = given.mapInArrow(lambda batches: _chunks(batches, model.span), f"chunk long, tokens long, ids array<{kind}>, blob binary")
    chunks = _bucketed(cut, "chunks", model)
    model = replace(model, tokens=int(chunks.agg(F.sum("tokens")).first()[0] or 0))
    none = F.array().cast("array<struct<kind: int, bucket: int, blob: binary>>")
    rows = chunks.select("chunk", "ids", "blob", none.alias("replies"))
    for ask, name in ((_ask_counts, "counts"), (_ask_triples, "triples"), (_ask_histories, "histories")):
        found = _exchange(rows.drop("ids"), ask, model, name)
        if ask is _ask_counts:
            model = replace(model, types=int(found.agg(F.sum("types")).first()[0] or 0))
        more = found.select("chunk", F.col("replies").alias("more"))
        rows = rows.join(more, "chunk", "left").select("chunk", "ids", "blob", F.concat("replies", F.coalesce("more", none)).alias("replies"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            n, known, base, said = _read(next(_each(iter([batch]), model)))
            ids = batch.column(batch.schema.get_field_index("ids"))[0].values
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n, known, base, said))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = rows.mapInArrow(read, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("held_out", held_out).withColumn("train_tokens", F.lit(model.tokens).cast("long")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
