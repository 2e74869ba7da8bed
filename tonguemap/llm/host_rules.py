"""Quality rules per document and per host, in column expressions only.

Every text is measured in one projection next to the scan. Four rules mark failing documents; failures
are summed per host; a beta prior fitted to all hosts shrinks the failure rate of each host, so a host
of three bad pages is not condemned by them; and the host's verdict is joined back to its documents.

A host is judged against that prior: it is rejected when even the lower bound of its shrunken rate (``Z`` standard
deviations down) is above the upper fifth of the prior, and far from its mean: above twice the mean, or halfway from
the mean to one where that is less. Where hosts do not differ beyond chance none is rejected.

Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows count as
often as they occur. An empty table gives an empty result. Measures of very long texts take time in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.llm.common import WORD
from tonguemap.operators.stage import stage

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
Z = 1.645  # standard deviations of a host's rate
PRIOR_Z = 0.84  # standard deviations of the prior: its upper fifth
MULTIPLE = 2.0  # of the mean of the prior
WEAKEST_PRIOR = 2.0
STRONGEST_PRIOR = 1e6

SYMBOLS = r"[#*$%&|<>]"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    # one-letter separators split without a regular expression
    plain = F.regexp_replace(text, r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(plain, " "), "")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: window keys are sorted, equal neighbours are
    repeats, and each repeat adds the words up to the next one, three at most."""

    def windows(w: Column) -> Column:
        key = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), key))

    def repeats(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(marked, F.isnotnull))

    def covered(p: Column) -> Column:
        step = F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3))))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    counted = _let(_let(_let(words, windows), repeats), covered)
    return F.when(F.size(words) >= 3, counted).otherwise(F.lit(0)).cast("long")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of each text instead of the text."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in docs.columns if c != text and c not in MEASURES]
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    cut = docs.select(*kept, t.alias("_t"), words_of(t).alias("_w"), lines.alias("_l"))
    return cut.select(
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
    )


def judged(measures: DataFrame) -> DataFrame:
    """Measures with ``base_failed``, and ``failed`` when any rule fails."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines")
    return measures.withColumn("base_failed", base).withColumn("failed", base | symbols | lines)


def host_verdicts(judgements: DataFrame, host: str = "source", z: float = Z, prior_z: float = PRIOR_Z, multiple: float = MULTIPLE) -> DataFrame:
    """Per host: documents, failures, shrunken rate and verdict.

    The prior has the mean of all documents. Its weight comes from how far host rates spread beyond
    what chance explains; it is between two documents (hosts differ widely) and a million (no spread).
    One row of sums goes to the driver.
    """
    hosts = judgements.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), F.count(F.when(F.col("failed"), 1)).alias("n_failed")
    )
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    s = hosts.agg(F.sum(n), F.sum(k), F.sum(k * k / n), F.count(F.lit(1))).first()
    docs, failed, squares, count = (float(x or 0) for x in s)
    mean = failed / docs if docs else 0.0
    chance = mean * (1 - mean)
    spread = (squares - docs * mean * mean - chance * count) / docs if docs else 0.0
    weight = min(max(chance / spread - 1, WEAKEST_PRIOR), STRONGEST_PRIOR) if spread > 0 else STRONGEST_PRIOR
    rate = (k + F.lit(weight * mean)) / (n + F.lit(weight))
    bound = F.col("host_rate") - F.lit(z) * F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (n + F.lit(weight + 1)))
    usual = max(mean + prior_z * (chance / (weight + 1)) ** 0.5, min(multiple * mean, (1 + mean) / 2))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", bound > F.lit(usual))


def host_rules(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """Per document the measures, ``base_failed`` and ``kept``.

    The measures are a written table of a few numbers per document, read once for the hosts and once for
    the verdicts. The join is on the host; a host with a third of all rows has one row on its other side,
    which Spark broadcasts if small, or splits the hot side of.
    """
    rows = judged(stage(measured(docs.select("doc_id", F.col(host).alias("_host"), text), text), "measures"))
    verdicts = host_verdicts(rows, "_host").select(F.col("_host").alias("_of"), "host_rejected")
    return rows.join(verdicts, F.col("_host").eqNullSafe(F.col("_of")), "left").select(
        "doc_id", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept")
    )
