"""Stop-word language heuristic as plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap import dims
from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions.once import once


def leading_tokens(text: Column, n: int | None) -> Column:
    """The text in lower case, up to and including its ``n``-th word token if there is a limit."""
    w = dims.WORD_CHARS
    if n is None:
        return F.lower(text)
    return F.regexp_extract(F.lower(text), rf"^(?:[^{w}]*+[{w}]++){{0,{n}}}+", 0)


def stop_word_tokens(text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Those tokens that are a stop word of any language."""
    tokens = F.regexp_extract_all(leading_tokens(text, cfg.max_text_tokens), F.lit(f"[{dims.WORD_CHARS}]++"), F.lit(0))
    known = sorted({w for words in dims.STOP_WORDS.values() for w in words})
    return F.filter(tokens, lambda t: t.isin(known))


def hits_struct(stop_tokens: Column) -> Column:
    """Stop-word hits per language, from :func:`stop_word_tokens` kept in a column of its own."""
    def hits(words: list[str]) -> Column:
        return F.size(F.filter(stop_tokens, lambda t: t.isin(words)))

    return F.struct(*[hits(words).alias(c) for c, words in dims.STOP_WORDS.items()])


@once
def _hits(stop_tokens: str) -> Column:
    return hits_struct(F.col(stop_tokens))


def with_text_language(df: DataFrame, text: str, out: str, hits: str | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add the language of a text column, and its hits if wanted; one step per column, so none runs twice."""
    counted = df.withColumn("_stop", stop_word_tokens(F.col(text), cfg)).withColumn("_hits", _hits("_stop"))
    named = counted.withColumn(out, best_language(F.col("_hits"), F.col(text), cfg)).drop("_stop")
    return named.withColumnRenamed("_hits", hits) if hits else named.drop("_hits")


def best_language(hits: Column, text: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Language with most hits, given the struct of :func:`hits_struct`; NULL below the minimum."""
    langs = list(dims.STOP_WORDS)
    top = F.greatest(*[hits[c] for c in langs])
    first = reduce(lambda acc, c: acc.when(hits[c] == top, F.lit(c)), langs[1:], F.when(hits[langs[0]] == top, F.lit(langs[0])))
    return F.when((F.length(text) >= cfg.min_text_chars) & (top >= cfg.min_stop_word_hits), first)
