"""Byte-level BPE encoding and decoding by a sentencepiece model made from a rank file.

The rank file (one base64 token and its rank per line) becomes a sentencepiece BPE model without any
training: each token is a piece in which every byte is one letter, its score is the negative rank, and
normalisation is the identity. Sentencepiece merges the best-scored adjacent pair first, leftmost of
equals, which is the rank order of byte-level BPE. Texts are cut into pre-tokens by a pattern and each
distinct pre-token is encoded by itself; decoding maps ids back to bytes.

The model is the fixed vocabulary file, so its broadcast (2 MB at 50,000 tokens) does not grow with data.

Nulls count as empty texts, empty texts have no ids. Texts of any length are encoded whole; an empty table gives an
empty result. Repeated rows give repeated rows. All other
columns are kept as they are, of whatever name; an existing output column is replaced.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonguemap.llm.common import slices

FIRST_LETTER = 0x100  # byte b is the letter chr(0x100 + b)
UNKNOWN = "unknown"
MAX_CACHED = 200_000  # distinct pre-tokens a task remembers
MAX_CACHED_LETTERS = 64

_LETTERS = {b: chr(FIRST_LETTER + b) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which must be 0, 1, 2, …"""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, open(path, "rb")))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count from 0 without gaps")
    return [token for _, token in pairs]


def letters(token: bytes) -> str:
    return token.decode("latin-1").translate(_LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protocol buffer field: text or message, 32-bit float, or integer."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value % (1 << 64))


def model_proto(tokens: list[bytes]) -> bytes:
    """Serialised sentencepiece model: piece 0 is unknown, piece i + 1 is the token of rank i."""
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, UNKNOWN) + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, letters(t)) + _field(2, -float(rank)) + _field(3, normal) for rank, t in enumerate(tokens)]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(45, UNKNOWN)
    trainer += b"".join(_field(n, -1) for n in (41, 42, 43))  # no begin, end and padding pieces
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Encoder:
    """Encoder of one model, with a bounded memory of pre-tokens."""

    def __init__(self, proto: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.cut = regex.compile(pattern).findall
        # numbers in tuples: unlike hundreds of thousands of lists, they cost the garbage collector nothing
        self.known: dict[str, tuple[int, ...]] = {}
        self.rank_of = list(range(-1, self.model.get_piece_size() - 1)).__getitem__  # the same objects each time

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of some texts; their new pre-tokens go to the model in one call."""
        parts = [self.cut(t) for t in texts]
        found = [list(map(self.known.get, p)) for p in parts]
        gaps = [i for i, f in enumerate(found) if None in f]
        new = list({p for i in gaps for p, ids in zip(parts[i], found[i]) if ids is None})
        # one thread: starting a pool of them in each call would take longer than encoding
        coded = self.model.encode([letters(p.encode()) for p in new], num_threads=1)
        fresh = {p: tuple(map(self.rank_of, ids)) for p, ids in zip(new, coded)}
        for i in gaps:
            found[i] = [fresh[p] if ids is None else ids for p, ids in zip(parts[i], found[i])]
        if len(self.known) + len(fresh) > MAX_CACHED:
            self.known.clear()
        self.known.update((p, ids) for p, ids in fresh.items() if len(p) <= MAX_CACHED_LETTERS)
        return [list(chain.from_iterable(f)) for f in found]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def _codec(proto: bytes, pattern: str) -> Encoder:
    return Encoder(proto, pattern)


def _with_column(batch: pa.RecordBatch, kept: list[str], name: str, column: pa.Array) -> pa.RecordBatch:
    """The kept columns, which come first in the batch, and one more."""
    return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], column], names=[*kept, name])


def _given(docs: DataFrame, kept: list[str], name: str, kind: T.DataType) -> tuple[DataFrame, int]:
    """The kept columns with the one to work on, and its place: texts and ids fill most of a batch, so a kept one goes once."""
    if name in kept and docs.schema[name].dataType == kind:
        return docs.select(*kept), kept.index(name)
    return docs.select(*kept, F.col(name).cast(kind).alias("given")), len(kept)


def _lists(values: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter(chain.from_iterable(values), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text as array<int>."""
    model = docs.sparkSession.sparkContext.broadcast(model_proto(read_ranks(ranks_path)))

    kept = [c for c in docs.columns if c != ids]
    given, at = _given(docs, kept, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, pattern)
        for batch in slices(batches, 64):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            yield _with_column(batch, kept, ids, _lists(codec.encode_all(texts)))

    return given.mapInArrow(run, _schema(docs, kept, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each id list; null lists give no bytes. The inverse mapping is a table of bytes by id, taken
    for a run of rows at once."""
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    kept = [c for c in docs.columns if c != decoded]
    given, at = _given(docs, kept, ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = pa.array(tokens.value, pa.large_binary())
        for batch in slices(batches):
            yield _with_column(batch, kept, decoded, joined(by_id, batch.column(at)))

    return given.mapInArrow(run, _schema(docs, kept, decoded, T.BinaryType()))


def joined(by_id: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The bytes of the ids of each list, end to end."""
    taken = by_id.take(lists.flatten())
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = at[np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), taken.buffers()[2]])


def _schema(docs: DataFrame, kept: list[str], name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, kind)])


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of what they decode to."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks_path, pattern).drop("text"), ranks_path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


