r"""Chat formatting by columnar byte assembly, with a loss mask, and the way back.

A turn is written as ``<s>[INST] text [/INST]`` (user), ``<s>[REPLY] text </s>`` (assistant) or
``<s>[ROLE] role [/ROLE] text </s>`` (any other role). Control strings inside texts and roles are broken
by a backslash after their first letter, and backslashes doubled, so texts can't forge turns and every
text comes back as it was.

Assembly works on whole columns: the lengths of heads, texts and tails of all turns give, by cumulative
sums, where each goes, and the bytes are scattered into one preallocated buffer that becomes the Arrow
column. The loss mask of a row lists the byte ranges of assistant texts in it.

A conversation is written in parts of ``PART_TURNS`` turn numbers, spread over tasks, so that one that
holds a third of all turns is not formatted by one task. A part with more than ``PIECE_TURNS`` turns (of
the same numbers) is cut into pieces. Reading back streams over the parts of a conversation in order.

Turns are in the order of turn, role, text, nulls first. Null texts and roles count as empty, a null
conversation id is a conversation of its own, repeated rows are repeated turns. Further columns are
ignored. An empty table gives no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[ROLE]", "[/ROLE]"]
PART_TURNS = 256
PIECE_TURNS = 4096
SLICE_TURNS = 2048
LONG = 1 << 16  # longer texts are copied by themselves, without an index per byte

FORMATTED = "conv_id {}, part long, piece int, n_turns long, formatted binary, loss_starts array<long>, loss_ends array<long>"


def escape(texts: pa.Array) -> pa.Array:
    out = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROLS:
        out = pc.replace_substring(out, c, c[0] + "\\" + c[1:])
    return out


def unescape(text: bytes) -> bytes:
    return b"\\".join(part.replace(b"\\", b"") for part in text.split(b"\\\\"))




def frame(role: str) -> tuple[bytes, bytes]:
    """What stands before and after the text of a turn."""
    if role == "user":
        return b"<s>[INST] ", b" [/INST]"
    if role == "assistant":
        return b"<s>[REPLY] ", b" </s>"
    return b"<s>[ROLE] " + escape(pa.array([role]))[0].as_py().encode() + b" [/ROLE] ", b" </s>"


def parse(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn."""
    out = []
    for turn in formatted.split(b"<s>")[1:]:
        if turn.startswith(b"[INST] "):
            role, text = b"user", turn[len(b"[INST] ") : -len(b" [/INST]")]
        elif turn.startswith(b"[REPLY] "):
            role, text = b"assistant", turn[len(b"[REPLY] ") : -len(b" </s>")]
        else:
            role, text = turn[len(b"[ROLE] ") : -len(b" </s>")].split(b" [/ROLE] ", 1)
        out.append((unescape(role), unescape(text)))
    return out


def _scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
    """Copy source[start : start + size] to out[at : at + size] for all rows of three arrays."""
    long = size > LONG
    for a, s, n in zip(at[long].tolist(), start[long].tolist(), size[long].tolist()):
        out[a : a + n] = source[s : s + n]
    at, start, size = at[~long], start[~long], size[~long]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + step] = source[np.repeat(start, size) + step]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a column without nulls, as large binary."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Formatted rows and their masks. ``first``: the number of the first turn of each row."""
    n = len(roles)
    coded = roles.dictionary_encode()
    frames = [frame(r) for r in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    content, offset = _bytes(escape(texts))
    pieces = [(np.frombuffer(b"".join(f[i] for f in frames), np.uint8), np.array([len(f[i]) for f in frames], np.int64)) for i in (0, 1)]
    size = np.empty((n, 3), np.int64)
    size[:, 0], size[:, 1], size[:, 2] = pieces[0][1][code], np.diff(offset), pieces[1][1][code]
    end = np.cumsum(size.ravel()).reshape(n, 3)
    at = end - size
    out = np.empty(int(end[-1, 2]), np.uint8)
    for i, (data, length) in ((0, pieces[0]), (2, pieces[1])):
        _scatter(out, at[:, i], data, (np.cumsum(length) - length)[code], size[:, i])
    _scatter(out, at[:, 1], content, offset[:-1], size[:, 1])
    starts = at[first, 0]
    bounds = np.append(starts, len(out))
    rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(out)])
    is_loss = np.array([r == "assistant" for r in coded.dictionary.to_pylist()])[code]
    row_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))[is_loss]
    per_row = np.append(0, np.cumsum(np.bincount(row_of, minlength=len(first)))).astype(np.int32)
    ends = [pa.array(x[is_loss, 1] - starts[row_of]) for x in (at, end)]
    return rows.cast(pa.binary()), *(pa.ListArray.from_arrays(pa.array(per_row), e) for e in ends)


def _rows(turns: pa.Table, piece: int) -> tuple[pa.RecordBatch, int]:
    """Formatted rows of sorted turns, one per conversation and part. ``piece``: number of the first row."""
    turns = turns.combine_chunks()
    keys = [turns.column(c).dictionary_encode().combine_chunks() for c in ("conv_id", "part")]
    codes = [k.indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
    change = np.append(True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1]))
    first = np.flatnonzero(change)
    one = lambda c: turns.column(c).combine_chunks() if turns.num_rows else turns.column(c)
    formatted, starts, ends = assemble(one("role"), one("text"), first)
    pieces = np.zeros(len(first), np.int32)
    pieces[0] = piece
    count = pa.array(np.diff(np.append(first, turns.num_rows)))
    ids, parts = (turns.column(c).take(pa.array(first)).combine_chunks() for c in ("conv_id", "part"))
    names = ["conv_id", "part", "piece", "n_turns", "formatted", "loss_starts", "loss_ends"]
    return pa.RecordBatch.from_arrays([ids, parts, pa.array(pieces), count, formatted, starts, ends], names=names), int(first[-1])


def _format_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, piece = None, 0  # turns of the last row so far, and its piece number
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE_TURNS):
            new = pa.Table.from_batches([batch.slice(i, SLICE_TURNS)])
            held = new if held is None else pa.concat_tables([held, new])
            rows, last = _rows(held, piece)
            if last:  # all rows but the last are whole
                yield rows.slice(0, rows.num_rows - 1)
                held, piece = held.slice(last), 0
            elif held.num_rows >= PIECE_TURNS:
                yield rows
                held, piece = None, piece + 1
    if held is not None:
        yield _rows(held, piece)[0]


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations in parts: see ``FORMATTED``. ``turns``: conv_id, turn, role, text."""
    given = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "turn", "role", "text")]
    dealt = given.repartition("conv_id", "part").sortWithinPartitions(*order)
    return dealt.mapInArrow(_format_sorted, FORMATTED.format(given.schema["conv_id"].dataType.simpleString()))


class _Reader:
    """Digests of one conversation, fed part by part."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def feed(self, formatted: bytes, starts: list[int], ends: list[int]) -> None:
        self.chars += len(formatted.decode())
        for role, text in parse(formatted):
            self.turns.update(role + b"\n" + text + b"\n")
            self.n_turns += 1
        for s, e in zip(starts, ends):
            text = unescape(formatted[s:e])
            self.loss.update(text)
            self.loss_chars += len(text.decode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id {}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted parts and masks hold.

    A digest is made of all bytes in order, so the parts of a conversation pass through one task, as a
    stream of which it keeps one part at a time.
    """
    schema = READ.format(formatted.schema["conv_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                conv, data, starts, ends = (batch.column(c)[i].as_py() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))
                if reader is None or conv != key:
                    if reader is not None:
                        done.append((key, *reader.row()))
                    key, reader = conv, _Reader()
                reader.feed(data, starts, ends)
            yield _batch(done, batch.schema.field("conv_id").type)
        if reader is not None:
            yield _batch([(key, *reader.row())], batch.schema.field("conv_id").type)

    def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "piece")]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)
