"""The registered queries of this subpackage, each over its whole table, and SQL checks where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


RANKS = "byte_bpe_50k.tiktoken"


@query
def op6_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import bpe

    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query
def op2_host_rules(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import host_rules

    return host_rules.host_rules(table(spark, sf, "documents"))


# Hosts of the given tables do not differ beyond chance; tests/llm/test_host_rules.py runs this SQL on tables where they do.
ORACLE["op2_host_rules"] = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
d AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * len(ls) AS failed FROM d),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (failed) AS DOUBLE) AS k FROM f GROUP BY source),
s AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS docs, sum(k * k / n) AS squares, count(*) AS hosts FROM h),
p AS (SELECT mean, (squares - docs * mean * mean - mean * (1 - mean) * hosts) / docs AS spread FROM s),
q AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 2), 1e6) ELSE 1e6 END AS weight FROM p),
v AS (SELECT source, n, weight, greatest(mean + 0.84 * sqrt(mean * (1 - mean) / (weight + 1)), least(2 * mean, (1 + mean) / 2)) AS usual,
    (k + weight * mean) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rate - 1.645 * sqrt(rate * (1 - rate) / (n + weight + 1)) > usual AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import mixing

    return mixing.mix(table(spark, sf, "documents"))


@query
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import simhash

    return simhash.digests(table(spark, sf, "documents"))


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import toxicity

    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_chat(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import chat

    one = spark.sql("""SELECT -1L AS conv_id, id AS turn, if(id = 0, 'user', 'assistant') AS role,
        '</s>[INST] ok [/INST]' AS text FROM range(2)""")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(one)
    return chat.read_back(chat.format_chats(turns))


def _chat_sql() -> str:
    from tonguemap.llm import chat

    def escaped(x: str) -> str:
        out = rf"replace({x}, '\', '\\')"
        for c in chat.CONTROLS:
            out = rf"replace({out}, '{c}', '{c[0]}\{c[1:]}')"
        return out

    order = "ORDER BY turn NULLS FIRST, r, t"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(r, chr(10), t, chr(10)), '' {order})) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' {order})) AS loss_sha256,
  CAST(sum(length({escaped('t')}) + CASE r WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'assistant' THEN length('<s>[REPLY]  </s>')
    ELSE length('<s>[ROLE]  [/ROLE]  </s>') + length({escaped('r')}) END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


ORACLE["op5_chat"] = _chat_sql()


@query
def op10_lm(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import lm

    return lm.score(table(spark, sf, "documents"))


@query
def op3_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import embeddings

    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@query
def op9_pii(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import pii

    return pii.digests(table(spark, sf, "documents"))


@query
def op4_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import suffixes

    return suffixes.repeated_passages(table(spark, sf, "documents"))


@query
def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import alignment

    return alignment.align(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
        public_tokenizers.PATTERN)


@query
def op12_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import exact

    return exact.duplicates(table(spark, sf, "documents"))


ORACLE["op12_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""


@query
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.llm import whitening

    return whitening.whiten(table(spark, sf, "embeddings"))
