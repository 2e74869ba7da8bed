r"""Personal data in texts: base patterns, and bootstrapped contextual extraction, in column expressions only.

E-mail, IP, card and phone patterns give base spans. They are also the seeds of a bootstrap that finds
identifiers no pattern was written for:

* An instance is a run of non-space characters that has a digit and eight characters or more once
  labels and punctuation around it are taken off.
* Its lexical patterns are the label inside the run (``password=``), the word before it, the two words
  before it, and the letters it starts with, if they are capitals (``AKIA…``).
* Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the mean score of
  its distinct instances, with one imaginary instance of score 0; an instance's score is 1 for a seed and
  else the noisy-or of its patterns that have enough distinct instances.
* Instances that end with ``MIN_SCORE`` or more are identifiers wherever they stand, unless they overlap
  a base span. Their kind is ``id``.

Splitting a text at the matches of a pattern gives the pieces between them, whose lengths give the
positions of the matches; no text is read by Python. Patterns start at the start of a run or where the
last match ended and never give back what they have read, so the time is linear in the length of a text.

Null texts count as empty and have no spans. Repeated rows have the same spans each. Further columns
are kept by ``redacted`` and ignored otherwise. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.operators.stage import stage

KINDS = ["email", "ip", "card", "phone", "id"]
_S = r"[^\x20\x09-\x0D]"

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = rf"(?<!{_S})(?=[^\x20\x09-\x0D0-9]*+[0-9]){_S}{{8,}}+"

MIN_CHARS = 8
MIN_PATTERN = 3  # distinct instances that a pattern must have
MIN_SCORE = 0.7
ROUNDS = 3
CONTEXT_CHARS = 80  # a pattern looks back no further
CHUNK = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.transform(F.array(value), body)[0]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _top(xs: Column) -> Column:
    return F.coalesce(F.array_max(xs), F.lit(0))


def before(values: Column, total=_sum, plus=lambda a, b: a + b) -> Column:
    """For each element the total of the earlier ones, in two levels so that long lists stay cheap."""

    def chunks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / CHUNK).cast("int")), lambda c: total(F.slice(s, c * CHUNK + 1, F.lit(CHUNK))))

    def starts(c: Column) -> Column:
        return F.transform(c, lambda _, i: total(F.slice(c, F.lit(1), i)))

    def placed(s: Column, c: Column) -> Column:
        chunk = lambda i: F.floor(i / CHUNK).cast("int")
        return F.transform(s, lambda _, i: plus(F.get(c, chunk(i)), total(F.slice(s, chunk(i) * CHUNK + 1, i % CHUNK))))

    return _let(values, lambda s: _let(_let(chunks(s), starts), lambda c: placed(s, c)))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern: array of (start, end, value, left), in code points; ``left`` is the text since the last one."""
    pieces, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(x: Column) -> Column:
        both = F.transform(x["v"], lambda v, i: F.struct(F.char_length(F.get(x["p"], i)).alias("gap"), F.char_length(v).alias("n")))
        ends = lambda b: before(F.transform(b, lambda y: y["gap"] + y["n"]))

        def rows(b: Column) -> Column:
            return _let(ends(b), lambda at: F.transform(x["v"], lambda v, i: F.struct(
                (F.get(at, i) + F.get(b, i)["gap"]).alias("start"),
                (F.get(at, i) + F.get(b, i)["gap"] + F.get(b, i)["n"]).alias("end"),
                v.alias("value"), F.right(F.get(x["p"], i), F.lit(CONTEXT_CHARS)).alias("left"))))

        return _let(both, rows)

    return _let(F.struct(pieces.alias("p"), values.alias("v")), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does the Luhn sum of a digit string end in zero?"""
    each = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.substr(digits, i, F.lit(1)).cast("int") * F.when((F.char_length(digits) - i) % 2 == 1, 2).otherwise(1))
    return _sum(F.transform(each, lambda d: F.when(d > 9, d - 9).otherwise(d))) % 10 == 0


def valid_ip(value: Column) -> Column:
    return value.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def valid_card(value: Column) -> Column:
    d = _digits(value)
    return F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False)


def valid_phone(value: Column) -> Column:
    return F.char_length(_digits(value)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end), by kind and start."""
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def of(kind: int, pattern: str, hint: Column, valid) -> Column:
        found = matches(text, pattern)
        found = F.filter(found, lambda m: valid(m["value"])) if valid else found
        spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(hint, spans).otherwise(nothing)

    return F.concat(
        of(0, EMAIL, F.contains(text, F.lit("@")), None),
        of(1, IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), valid_ip),
        of(2, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), valid_card),
        of(3, PHONE, text.rlike(r"\+[0-9]"), valid_phone),
    )


def candidates(text: Column) -> Column:
    """Array of instances: (start, end, value, patterns)."""
    label = r"^(?:[^\x20\x09-\x0D0-9=:]++[=:])?[^A-Za-z0-9]*+"
    tail = r"[^A-Za-z0-9]++$"

    def described(m: Column) -> Column:
        labelled = F.struct(m.alias("m"), F.regexp_extract(m["value"], label, 0).alias("head"))
        return _let(_let(labelled, stripped), lambda x: F.struct(
            x["start"].alias("start"), (x["start"] + F.char_length(x["core"])).alias("end"), x["core"].alias("value"), patterns(x).alias("patterns")))

    def stripped(x: Column) -> Column:
        n = F.char_length(x["head"])
        return F.struct(
            (x["m"]["start"] + n).alias("start"),
            F.regexp_replace(F.substr(x["m"]["value"], n + 1), tail, "").alias("core"),
            F.lower(F.regexp_extract(x["head"], "[A-Za-z][^=:]*[=:]", 0)).alias("name"),
            F.regexp_extract_all(F.lower(x["m"]["left"]), F.lit(rf"{_S}++"), F.lit(0)).alias("words"),
        )

    def patterns(x: Column) -> Column:
        words = x["words"]
        capitals = F.regexp_extract(x["core"], "^[A-Z]{3,}(?=[A-Z0-9])", 0)
        return F.filter(F.array(
            F.when(x["name"] != "", F.concat(F.lit("label "), x["name"])),
            F.when(F.size(words) > 0, F.concat(F.lit("word "), F.get(words, F.size(words) - 1))),
            F.when(F.size(words) > 1, F.concat_ws(" ", F.lit("words"), F.get(words, F.size(words) - 2), F.get(words, F.size(words) - 1))),
            F.when(capitals != "", F.concat(F.lit("capitals "), F.substring(capitals, 1, 4))),
        ), F.isnotnull)

    found = F.transform(matches(text, TOKEN), described)
    kept = F.filter(found, lambda x: (F.char_length(x["value"]) >= MIN_CHARS) & x["value"].rlike("[0-9]"))
    nothing = F.array().cast("array<struct<start:int,end:int,value:string,patterns:array<string>>>")
    return F.when(text.rlike("[0-9]"), kept).otherwise(nothing)


def extracted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, h (hash of the text), base spans, and the instances with whether a base span covers them."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), t.alias("_t"))
    found = rows.select("doc_id", "h", base_spans(F.col("_t")).alias("base"), candidates(F.col("_t")).alias("found"))
    overlaps = lambda x: F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return found.select("doc_id", "h", "base", F.transform("found", lambda x: x.withField("seed", overlaps(x))).alias("found"))


def identifier_scores(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, score) of the instances that are no seed anywhere. ``instances``: value, patterns, seed.

    Edges are distinct and pre-aggregated, so what occurs often counts once. A pattern that a third of
    all instances share is summed before each shuffle; its edges are the side of a join that can be split.
    """
    edges = instances.select("value", "seed", F.explode("patterns").alias("pattern"))
    edges = stage(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    scores = stage(edges.groupBy("value").agg(F.max("seed").cast("double").alias("score")), "scores")
    for _ in range(rounds):
        # pairs of few patterns and values compress so well that Spark would broadcast too many of them
        confidence = edges.hint("merge").join(scores, "value").groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("sure"), F.count(F.lit(1)).alias("n")
        ).where(F.col("n") >= MIN_PATTERN)
        doubt = F.sum(F.log1p(-F.least(F.col("sure"), F.lit(1 - 1e-9))))
        found = edges.hint("merge").join(confidence, "pattern").groupBy("value").agg((-F.expm1(doubt)).alias("found"))
        seeds = edges.groupBy("value").agg(F.max("seed").alias("seed"))
        # rounded, so that the order in which Spark sums can't matter at the threshold
        new = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.round(F.coalesce("found", F.lit(0.0)), 9))
        scores = stage(seeds.join(found, "value", "left").select("value", "seed", new.alias("score")), "scores")
    return scores.where(~F.col("seed")).select("value", "score")


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_score: float = MIN_SCORE) -> DataFrame:
    """Per row: doc_id, h, base and more, the discovered spans, both arrays of (kind, start, end)."""
    rows = stage(extracted(docs, text, doc_id), "extracted")
    each = rows.select("doc_id", "h", F.explode("found").alias("f")).select("doc_id", "h", "f.*")
    sure = identifier_scores(each).where(F.col("score") >= min_score).select("value")
    # a value is in one row of sure; a semi join never broadcasts the exploded rows, which Spark takes for few
    hits = each.where(~F.col("seed")).join(sure, "value", "left_semi").select(
        F.col("doc_id").alias("_id"), F.col("h").alias("_h"),
        F.struct(F.lit(KINDS.index("id")).alias("kind"), "start", "end").alias("span"))
    more = hits.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("span")).alias("more"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(more, same, "left").select("doc_id", "h", "base", F.coalesce("more", nothing).alias("more"))


def _listed(found: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat("base", "more")).alias("spans"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each run of personal data replaced by its kind, as ``<email>``; n_chars is counted again.

    Where spans overlap, their union is replaced, named after the one that starts first.
    """
    found = spans(docs).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.concat("base", "more").alias("_s"))
    found = found.where(F.size("_s") > 0).dropDuplicates(["_id", "_h"])
    by_start = F.sort_array(F.transform("_s", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    name = lambda s: F.element_at(F.array(*[F.lit(f"<{k}>") for k in KINDS]), s["kind"] + 1)

    def steps(sorted_spans: Column) -> Column:
        """Each span with where what is before it ends."""
        reach = before(F.transform(sorted_spans, lambda x: x["end"]), _top, F.greatest)
        return _let(reach, lambda r: F.transform(sorted_spans, lambda x, i: x.withField("reach", F.get(r, i))))

    def rebuilt(s: Column) -> Column:
        parts = F.transform(s, lambda x: F.when(
            x["start"] >= x["reach"], F.concat(F.substr("text", x["reach"] + 1, x["start"] - x["reach"]), name(x))).otherwise(""))
        rest = F.substr(F.col("text"), F.array_max(F.transform(s, lambda x: x["end"])) + 1)
        return F.concat(F.array_join(parts, ""), rest)

    keyed = docs.withColumn("_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_h"))
    joined = keyed.join(found, same, "left")
    text = F.when(F.col("_s").isNull(), F.col("text")).otherwise(_let(_let(by_start, steps), rebuilt))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        n = F.when(F.col("_s").isNull(), F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
