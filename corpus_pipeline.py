"""Corpus pipeline: the stages that turn raw documents into a training set.

Each stage is a function of (spark, docs, sf_dir). It works on all that its predecessor kept, and all but
the last return the columns of ``documents``; the caller writes each result and reads it again. Nulls,
empty tables and repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.llm import bpe, mixing, pii, simhash, toxicity
from tonguemap.llm.common import utf8
from tonguemap.operators.stage import stage, stage_alone

RANKS = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it learns from the labels of those given."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group whose fingerprints link; the operator's contract sets
    shingles of four words and at most four differing bits."""
    return simhash.one_of_each_group(docs, shingle=4, radius=4)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words of each source as its target says: documents in up to three passes, cut at blocks."""
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with their number, digests, and whether they decode to the text.

    Ids are written before they are decoded, so that the two kinds of tasks don't take their memory at the same time. The
    digests of both texts are compared, so a text goes to the tasks that encode it and no further.
    """
    path = public_tokenizers.path(RANKS)
    # the ids take the place of the text
    kept = docs.select("doc_id", "source", F.sha2(utf8(F.col("text")), 256).alias("text_sha256"), F.col("text").alias("ids"))
    coded = bpe.decode(stage(bpe.encode(kept, path, public_tokenizers.PATTERN, text="ids"), "ids"), path)
    decoded_sha256 = F.sha2("decoded", 256)
    return coded.select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        decoded_sha256.alias("decoded_sha256"), (decoded_sha256 == F.col("text_sha256")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("bpe", tokens),
]

# Learnt scores, XXH64 fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written before the next one reads it; only these tables are left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage_alone(spark, partial(function, spark, docs, sf_dir), name)
    return docs
