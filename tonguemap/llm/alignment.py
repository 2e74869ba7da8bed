"""Alignment of the tokens of two tokenizers over the same bytes, and how often their ids are linked.

A is a byte-level BPE (``tokenizers`` file), B a sentencepiece BPE with byte fallback. Both see a text
after one space, so their tokens tile the same bytes.

1. Interval coalescing, many texts at a time: the tokens of A and B are put on one axis of bytes, on which each
   text has a stretch of its own, and lexsorted by start (A before B). The running maximum of their ends
   is taken, and a group breaks where a start reaches it, so groups are what the byte offsets cut where
   tokens of both end.
2. Overlaps expand within the groups: every start opens an interval that one token of A and one of B cover, and
   two tokens that overlap do so in one such interval. A link is a row of this list.
3. Links are counted per chunk of some ``CHUNK`` links, and chunks send each distinct pair of ids once, with its
   count. Spark adds them up over the corpus, finds the highest count of each id of B, and sends the totals
   back to the chunks that asked, where documents add them up. So no pair is hot, rows grow with the distinct
   pairs of the chunks, and nothing is broadcast but the two fixed vocabularies.

A's file lists its merges in the order of ids, so the lowest pair first is what ``tiktoken`` does too, at a fifth of
the cost; ids are the same in tests over all given documents and hostile strings. Texts with characters beyond the
Latin blocks, of which the libraries could hold different Unicode tables, go to ``tokenizers`` itself.

Null and empty texts, and texts whose joined tokens differ from space and text (B reads U+2581 as a space), have
no tokens: their numbers are zero and their groups empty. Repeated rows are a row each, and count each. Null ids
stay null, further columns are ignored, an empty table gives an empty result. Texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonguemap.llm.common import slices
from tonguemap.operators.stage import stage

CHUNK = 500_000  # links
TOKENS = 200_000  # aligned in one go, unless one text has more
# A chunk is a row of some megabytes, and Parquet looks at the size of pages and row groups every hundred rows only. What a task
# has in memory to write and read them would grow with its input.
IN_PARTS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}
SPACE = "▁"  # how B writes a space
_OTHER_SCRIPT = re.compile("[^\x00-\u024F]")

def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _b_bytes(piece: str) -> bytes:
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode()


def read_a(path: str) -> tuple[str, list[bytes]]:
    """The file of A, and the bytes of its tokens in the order of their ids, which must be that of its merges."""
    text = open(path, encoding="utf-8").read()
    model, letters = json.loads(text)["model"], _byte_letters()
    spelled = lambda token: bytes(map(letters.__getitem__, token))
    tokens = [spelled(t) for t, _ in sorted(model["vocab"].items(), key=lambda e: e[1])]
    merges = [spelled("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if sorted(model["vocab"].values()) != list(range(len(tokens))) or tokens[-len(merges) :] != merges:
        raise ValueError("ids must be in the order of the merges")
    return text, tokens


class Vocabularies:
    """Both encoders, and the bytes of their tokens."""

    def __init__(self, a_json: str, a_bytes: list[bytes], b_model: bytes, pattern: str):
        self.a_json, self.a_bytes = a_json, a_bytes
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(a_bytes)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.b_bytes = [_b_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array(list(map(len, self.a_bytes)))
        self.b_sizes = np.array(list(map(len, self.b_bytes)))

    @cached_property
    def library(self):
        """The library the file of A is made for."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.a_json)
        out.encode_special_tokens = True  # their strings in a text are plain text
        return out

    def _a_ids(self, text: str) -> list[int]:
        if _OTHER_SCRIPT.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.a.encode_ordinary(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B of the texts end to end, and their numbers per text; none for texts that do not come back."""
        of_a, of_b = [], self.b.encode(texts, num_threads=1)
        for i, text in enumerate(texts):
            want = (" " + text).encode()
            ids = self._a_ids(" " + text) if text else []
            same = self.a.decode_bytes(ids) == want == b"".join(map(self.b_bytes.__getitem__, of_b[i]))
            of_a.append(ids if same else [])
            of_b[i] = of_b[i] if same else []
        n_a, n_b = (np.fromiter(map(len, of), np.int64, len(texts)) for of in (of_a, of_b))
        a, b = (np.fromiter(chain.from_iterable(of), np.int64, int(n.sum())) for of, n in ((of_a, n_a), (of_b, n_b)))
        return a, b, n_a, n_b


_loaded: dict[tuple, Vocabularies] = {}


def _vocabularies(files: Broadcast, pattern: str) -> Vocabularies:
    """Those of a broadcast, loaded once in each worker."""
    key = files.value[1][-1], len(files.value[1]), files.value[2], pattern
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabularies(*files.value, pattern)
    return _loaded[key]


@lru_cache(maxsize=2)
def _spelled(n_a: int, n_b: int) -> pa.Array:
    """Decimal ids with what follows them: a comma or the end of a side."""
    return pa.array([f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], pa.large_binary())


class Aligned:
    """Groups and links of some texts; a and b are the ids of all of them, n_a and n_b their numbers per text."""

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b = a, b
        ends = np.concatenate([np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])])  # texts lie end to end, each as long for A as for B
        sizes = np.concatenate([a_sizes[a], b_sizes[b]])
        starts = ends - sizes
        of_b = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
        order = np.lexsort((of_b, starts))
        starts, ends, of_b = starts[order], ends[order], of_b[order]
        reach = np.maximum.accumulate(ends)
        breaks = np.ones(len(starts), bool)
        breaks[1:] = starts[1:] >= reach[:-1]
        self.group = np.cumsum(breaks) - 1  # of each token, in order of starts
        # the last token of each start has all that began there before it
        last = np.ones(len(starts), bool)
        last[:-1] = starts[1:] != starts[:-1]
        so_far = np.cumsum(of_b, dtype=np.int64)
        at = np.flatnonzero(last)
        self.link_b = so_far[at] - 1
        self.link_a = at - so_far[at]
        self.of_b, self.order = of_b.astype(bool), order
        first_b, first_a = np.cumsum(n_b) - n_b, np.cumsum(n_a) - n_a
        self.n_links = np.diff(np.searchsorted(self.link_a, np.append(first_a, len(a)))) if len(a) else np.zeros(len(n_a), np.int64)
        self.group_a = self.group[~self.of_b]
        self.group_b = self.group[self.of_b]
        bounds = np.append(first_a, len(a))
        groups = np.append(self.group_a, self.group[-1] + 1 if len(self.group) else 0)
        self.first_group = groups[bounds]
        self.n_groups = np.diff(self.first_group)
        self.first_a, self.first_b, self.n_a, self.n_b = first_a, first_b, n_a, n_b

    def spelled(self, n_a: int, n_b: int) -> Iterator[bytes]:
        """Per text the ids of its groups: a1,a2|b1;a3|b2,b3."""
        groups = int(self.group[-1]) + 1 if len(self.group) else 0
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        # places of tokens when each group has first its tokens of A, then those of B
        place_a = np.arange(len(self.a)) + (np.cumsum(in_b) - in_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(in_a)[self.group_b]
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        end_a = np.append(np.diff(self.group_a) != 0, True)[: len(self.a)]
        end_b = np.append(np.diff(self.group_b) != 0, True)[: len(self.b)]
        codes[place_a] = self.a + end_a * n_a
        codes[place_b] = self.b + end_b * n_b + 2 * n_a
        taken = _spelled(n_a, n_b).take(pa.array(codes))
        at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        letters = taken.buffers()[2].to_pybytes() if len(taken) else b""
        ends = at[np.cumsum(self.n_a + self.n_b)].tolist()
        for start, end in zip([0, *ends], ends):
            yield letters[start : end - 1] if end > start else b""


def _align(vocabularies: Vocabularies, texts: list[str]) -> Iterator[tuple[Aligned, list[str]]]:
    """Runs of texts, aligned, with the digests of their groups."""
    a, b, n_a, n_b = vocabularies.encode(texts)
    cuts = np.flatnonzero(np.diff(np.cumsum(n_a + n_b) // TOKENS)) + 1
    end_a, end_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
    sizes = len(vocabularies.a_bytes), len(vocabularies.b_bytes)
    for s, e in zip([0, *cuts], [*cuts, len(texts)]):
        own = a[end_a[s] : end_a[e]], b[end_b[s] : end_b[e]]
        one = Aligned(*own, n_a[s:e], n_b[s:e], vocabularies.a_sizes, vocabularies.b_sizes)
        yield one, [hashlib.sha256(t).hexdigest() if t else "" for t in one.spelled(*sizes)]


def _packed(which: np.ndarray, distinct: int) -> bytes:
    """Numbers below ``distinct``, two bytes each where that is enough, else four."""
    return which.astype("<u2" if distinct <= 1 << 16 else "<u4").tobytes()


def _unpacked(which: pa.Scalar, distinct: int) -> np.ndarray:
    return np.frombuffer(which.as_buffer(), "<u2" if distinct <= 1 << 16 else "<u4")


class _Chunk:
    """Documents until they have ``CHUNK`` links."""

    def __init__(self, number: int):
        self.number, self.links = number, 0
        self.columns: list[list] = [[] for _ in range(7)]  # ids, n_a, n_b, n_groups, n_links, digests, pairs

    def add(self, ids: pa.Array, one: Aligned, digests: list[str], n_b: int) -> None:
        pairs = one.a[one.link_a] * n_b + one.b[one.link_b]
        for column, x in zip(self.columns, (ids, one.n_a, one.n_b, one.n_groups, one.n_links, digests, pairs)):
            column.append(x)
        self.links += len(pairs)

    def batch(self) -> pa.RecordBatch:
        ids, *numbers, digests, pairs = self.columns
        n_links = np.concatenate(numbers[-1])
        coded = pa.array(np.concatenate(pairs)).dictionary_encode()
        order = np.argsort(coded.dictionary.to_numpy())  # the few distinct pairs, not the links
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        distinct, which = coded.dictionary.to_numpy()[order], rank[coded.indices.to_numpy()]
        counts = np.bincount(which, minlength=len(distinct))
        of = pa.concat_arrays(ids)
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = [pa.array([self.number]), pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)]
        columns += [one(np.concatenate(x), pa.int64()) for x in numbers] + [one(list(chain.from_iterable(digests)), pa.string())]
        columns += [one(distinct, pa.int64()), one(counts, pa.int64()), pa.array([_packed(which, len(distinct))], pa.binary())]
        assert int(n_links.sum()) == len(which)
        return pa.RecordBatch.from_arrays(columns, names=CHUNKS)


CHUNKS = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pairs", "counts", "which"]
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(chunk: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a chunk with the sums over their links of what the corpus says about the pairs."""
    row = {c: chunk.column(c)[0].values for c in chunk.column_names if c not in ("chunk", "which")}
    which, n_links = _unpacked(chunk.column("which")[0], totals.num_rows), row["n_links"].to_numpy()
    order = np.argsort(totals.column("pair").to_numpy())
    bounds = np.append(0, np.cumsum(n_links))
    sums = []
    for name in ("best", "count"):
        each = totals.column(name).to_numpy().astype(np.int64)[order]
        running = np.append(0, np.cumsum(each[which])) if len(which) else np.zeros(1, np.int64)
        sums.append(pa.array(np.diff(running[bounds])))
    return pa.table([row["ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_links"], *sums, row["digests"]], names=DOC)


def align(docs: DataFrame, a_path: str, b_path: str, pattern: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``pattern`` splits texts ahead of the merges of A. Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    context = docs.sparkSession.sparkContext
    files = context.broadcast((*read_a(a_path), open(b_path, "rb").read()))  # fixed vocabularies
    n_pieces = sentencepiece.SentencePieceProcessor(model_proto=files.value[2]).get_piece_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _vocabularies(files, pattern)
        first, made = TaskContext.get().partitionId() << 32, 0
        chunk = _Chunk(first)
        for batch in slices(batches, 64):
            at = 0
            for one, digests in _align(vocabularies, batch.column(1).to_pylist()):
                chunk.add(batch.column(0).slice(at, len(digests)), one, digests, n_pieces)
                at += len(digests)
                if chunk.links >= CHUNK:
                    yield chunk.batch()
                    made += 1
                    chunk = _Chunk(first + made)
        if chunk.columns[0]:
            yield chunk.batch()

    kind = docs.schema[doc_id].dataType.simpleString()
    numbers = ", ".join(f"{c} array<long>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    chunks = stage(given.mapInArrow(
        run, f"chunk long, ids array<{kind}>, {numbers}, digests array<string>, pairs array<long>, counts array<long>, which binary"), "aligned", IN_PARTS)
    sent = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("r")).select("chunk", F.col("r.pairs").alias("pair"), "r.counts")
    counts = stage(sent.groupBy("pair").agg(F.sum("counts").alias("count")), "pair-counts")
    b = (F.col("pair") % n_pieces).alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))  # at most a row for each id of B
    known = counts.withColumn("b", b).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    # each pair is known; a left join never broadcasts the exploded rows, which Spark takes for few
    back = sent.select(F.col("chunk").alias("of"), "pair").join(known, "pair", "left")
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in DOC[1:-1]) + ", groups_sha256 string"
    return chunks.drop("pairs", "counts").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_looked_up, schema)
