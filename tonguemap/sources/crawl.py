"""The landed crawl: one row per fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import urls
from tonguemap.operators.skew import small_enough

FETCH_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("requested_url", T.StringType()),
        T.StructField("final_url", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FETCH_SCHEMA).parquet(path)


def fetch_ok() -> Column:
    return F.col("error").isNull() & F.coalesce(F.col("status_code").between(200, 399), F.lit(False))


def fetch_redirected() -> Column:
    def bare(c: str) -> Column:
        return F.regexp_replace(c, "/+$", "")

    return F.coalesce(F.col("error").isNull() & (bare("final_url") != bare("requested_url")), F.lit(False))


def error_line(kind: str) -> Column:
    """Log line of a failed fetch, ``page: <url>: timeout``; NULL without an error."""
    return F.concat(F.lit(f"{kind}: "), F.col("requested_url"), F.lit(": "), F.col("error"))


def failure_label(exception: Column) -> Column:
    """Error label of a failure class: two have their own, client errors and the rest carry the name."""
    client = F.element_at(F.split(exception, ":"), 1) == "client"
    name = F.element_at(F.split(exception, ":"), -1)
    return (
        F.when(name == "TimeoutError", "timeout")
        .when(name == "TooManyRedirects", "too_many_redirects")
        .when(client, F.concat(F.lit("client_error: "), name))
        .otherwise(F.concat(F.lit("unexpected_error: "), name))
    )


def seeds(domains: DataFrame, domain_col: str = "input_domain", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Start URL, host and registered domain of each input domain; ``error`` where it is unusable."""
    d = domains.withColumn("normalized_url", urls.start_url(F.col(domain_col)))
    d = d.withColumn("host", urls.host(F.col("normalized_url")))
    return d.withColumn("registered_domain", urls.registered_domain(F.col("host"), cfg.suffixes)).withColumn(
        "error",
        F.when(urls.strip(F.col(domain_col)) == "", "empty input").when(
            F.col("normalized_url").isNull(), "not a usable URL"
        ),
    )


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a public-suffix file: one rule per line, up to the first blank; ``//`` starts a remark."""
    line = F.regexp_extract("value", r"^\s*(\S*)", 1)
    return spark.read.text(path).select(F.lower(line).alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//"))


def suffix_rules(rules: DataFrame, cfg: EngineConfig = DEFAULT) -> tuple[str, ...]:
    """The rules as a setting. They are a reference list, whose size is checked, and not data."""
    if not small_enough(rules, cfg.max_broadcast_rows):
        raise ValueError(f"more than {cfg.max_broadcast_rows} suffix rules")
    return tuple(sorted({r.rule for r in rules.select("rule").collect()}))


def registered_domain_by_suffix(hosts: DataFrame, rules: DataFrame, host_col: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Add ``registered_domain`` by a table of public-suffix rules (column ``rule``), as :func:`urls.domain_of` reads them.

    Each distinct host is looked up by all of its endings in one join: for rule tables too large for a setting.
    """
    labels = F.filter(F.split("_host", "[.]"), lambda x: x != "")
    ending = lambda n: F.when(n <= F.size("_labels"), F.array_join(F.slice("_labels", -n, n), "."))
    name = F.regexp_replace(F.lower("rule"), r"^!|^\*\.|^\.+", "")
    kind = F.when(F.col("rule").startswith("!"), -1).when(F.col("rule").startswith("*."), 1).otherwise(0)
    named = rules.select(name.alias("_ending"), kind.alias("_more")).distinct()
    # a suffix of one label gives the last two labels, as no suffix does, so that nothing meets at ``com``
    named = named.where((F.col("_more") != 0) | F.col("_ending").contains("."))
    distinct = hosts.select(F.lower(host_col).alias("_host")).distinct().withColumn("_labels", labels)
    tails = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda n: F.struct(n.alias("n"), ending(n).alias("_ending")))
    endings = distinct.where(F.size("_labels") > 0).select("_host", "_labels", F.explode(tails).alias("t")).select("_host", "_labels", "t.*")
    known = endings.join(F.broadcast(named) if small_enough(named, cfg.max_broadcast_rows) else named, "_ending")
    # exceptions win over any length; the domain is NULL where the host is the suffix
    best = F.struct((F.col("_more") == -1).alias("e"), (F.col("n") + F.col("_more")).alias("n"), ending(F.col("n") + F.col("_more") + 1).alias("domain"))
    found = known.groupBy("_host").agg(F.max(best).alias("_best"))
    out = hosts.withColumn("_host", F.lower(host_col)).join(found, "_host", "left")
    domain = F.coalesce("_best.domain", urls.registered_domain(F.col(host_col)))
    return out.withColumn("registered_domain", domain).select(*hosts.columns, "registered_domain")
