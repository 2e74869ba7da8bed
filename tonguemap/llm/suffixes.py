"""Passages that repeat across documents, by sparse suffixes over words.

A suffix is kept where the text itself says so: at the word whose hash of ``GRAM`` words is the least of
``WINDOW`` neighbours. Any ``WINDOW + GRAM - 1`` equal words hold such a place, at the same word of each
copy, so suffixes of equal passages meet although only one in some twelve is kept.

1. Kept suffixes are grouped by the hash of their first ``PREFIX`` words; a group with suffixes of two
   documents is a match. They are not sorted, and neighbours are not compared: the least and the largest
   document of each group are pre-aggregated, so a beginning that a third of all documents share is no
   hot task, as it would be in a sorted table.
2. Matches are extended to the left and to the right: all windows of ``CELL`` words that hold the first
   ``PREFIX`` words of a matching place are laid, and those that equal a window of another document are kept.
3. Windows of a document that overlap or touch make a passage.

A run of ``MIN_WORDS`` equal words has a kept place among its first ``WINDOW`` words, so exactly the words of
such runs are found, and ends are exact. A passage joins the runs shared with any other documents;
listing it per partner would grow with the square of a passage's copies.

Words are compared by 64-bit hashes. Null and short texts have no passage. Rows that agree in id and text
are one document; the same text under two ids is a repeat. Further columns are ignored. Texts of any
length are read whole; an empty table gives no passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonguemap.llm.common import slices, utf8
from tonguemap.operators.stage import stage

MIN_WORDS = 50
GRAM = 8
WINDOW = 24
STEP = 1  # every window, so that ends are exact
CELL = MIN_WORDS - STEP + 1
PREFIX = MIN_WORDS - WINDOW + 1  # words of a passage from its first kept place on, at least

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Words:
    """Hashes of the runs of words of a text: a rolling hash modulo 2^64, scrambled."""

    def __init__(self, text: bytes):
        words = text.split()
        digest = xxhash.xxh64_intdigest
        self.n = len(words)
        power = np.full(self.n + 1, _BASE)
        inverse = np.full(self.n + 1, _INVERSE)
        power[:1] = inverse[:1] = 1
        self.inverse = np.multiply.accumulate(inverse)
        each = np.fromiter(map(digest, words), np.uint64, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(each * np.multiply.accumulate(power)[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each start on."""
        x = (self.sums[start + size] - self.sums[start]) * self.inverse[start]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # the scrambling steps of splitmix64
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def places(self) -> np.ndarray:
        """Kept places: the first least gram of each window, in order."""
        grams = self.n - GRAM + 1
        if grams < WINDOW:
            return np.zeros(0, np.int64)
        h = self.hashes(np.arange(grams), GRAM)
        least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(axis=1)
        return np.unique(least + np.arange(len(least)))


def window_starts(matched: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows laid over the matched places of a text of ``n`` words.

    Each place has all of its windows, also where those of the place before it would cover them: the
    other document may not keep that place.
    """
    starts = matched[:, None] - np.arange(0, WINDOW, STEP)
    return np.unique(starts[(starts >= 0) & (starts + CELL <= n)])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, places, heads = [], [], []
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Words(text)
            at = words.places()
            at = at[at + PREFIX <= words.n]
            rows.append(np.full(len(at), row, np.int64))
            places.append(at.astype(np.int32))
            heads.append(words.hashes(at, PREFIX).view(np.int64))
        columns = [pa.array(np.concatenate(x)) for x in (rows, places, heads)] if rows else []
        if columns:
            yield pa.RecordBatch.from_arrays(columns, names=["row", "place", "head"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        starts, cells = [], []
        for text, matched in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = Words(text)
            at = window_starts(np.array(matched, np.int64), words.n)
            starts.append(at.astype(np.int32))
            cells.append(words.hashes(at, CELL).view(np.int64))
        sizes = [len(x) for x in starts]
        of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        flat = [pa.array(np.concatenate(x)) for x in (starts, cells)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), *flat], names=["row", "start", "cell"])


def repeated_passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per passage of a document that is also in another one: doc_id, start_word, end_word (exclusive),
    n_words, and other_doc_id, a document that holds part of it."""
    key = F.xxhash64(F.col(doc_id), F.col(text)).alias("row")
    given = docs.select(key, F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("t"))
    suffixes = stage(given.select("row", "t").mapInArrow(_suffixes, "row long, place int, head long"), "suffixes")
    ends = [F.min("row").alias("first"), F.max("row").alias("last")]
    # written, so that the next join has nothing above its shuffles and Spark may split a hot beginning
    runs = stage(suffixes.groupBy("head").agg(*ends).where("first < last").select("head"), "runs")
    matched = suffixes.join(runs, "head").groupBy("row").agg(F.collect_list("place").alias("places"))
    over = given.join(matched, "row").select("row", "t", "places")
    cells = stage(over.mapInArrow(_cells, "row long, start int, cell long"), "cells")
    same = stage(cells.groupBy("cell").agg(*ends).where("first < last"), "same")
    other = F.when(F.col("first") != F.col("row"), F.col("first")).otherwise(F.col("last")).alias("other")
    found = cells.join(same, "cell").select("row", "start", other).groupBy("row", "start").agg(F.min("other").alias("other"))
    # the windows of one document only, so partitions here are as small as a document
    along = Window.partitionBy("row").orderBy("start")
    new = F.col("start") > F.coalesce(F.lag("start").over(along) + CELL, F.lit(-1))
    parts = found.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("part", F.sum("new").over(along))
    passages = parts.groupBy("row", "part").agg(
        F.min("start").alias("start_word"), (F.max("start") + CELL).alias("end_word"), F.min("other").alias("other"))
    ids = stage(given.select("row", "doc_id").distinct(), "ids")
    others = ids.select(F.col("row").alias("other"), F.col("doc_id").alias("other_doc_id"))
    return passages.join(ids, "row").join(others, "other").select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
