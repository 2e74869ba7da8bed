"""Queries over sources: domain lists, robots and sitemap files, fetches, published reports."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonguemap.functions import urls
from tonguemap.operators.stage import new_path
from tonguemap.plans import inputs
from tonguemap.plans.inputs import derive
from tonguemap.plans.registry import query
from tonguemap.sources import crawl, domains, reports, sitemaps


@query
def domains_file_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "domain-list")
    derive(spark, sf, inputs.DOMAIN_LINES).orderBy("seq").select("value").write.text(path)
    return domains.domains_from_lines(domains.read_lines(spark, path)).select("domain")


@query
def domains_token_scan(spark: SparkSession, sf: str) -> DataFrame:
    out = domains.domains_from_tokens(derive(spark, sf, inputs.DOMAIN_CELLS))
    return out.select("domain", "seq", F.col("pos").cast("long").alias("pos"))


@query
def domains_line_scan(spark: SparkSession, sf: str) -> DataFrame:
    values = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("value"))
    return domains.split_lines(values).select("seq", F.col("pos").cast("long").alias("pos"), "line")


@query
def domains_free_tokens(spark: SparkSession, sf: str) -> DataFrame:
    out = domains.split_tokens(derive(spark, sf, inputs.DOMAIN_CELLS))
    return out.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query
def robots_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    out = sitemaps.robots_sitemaps(derive(spark, sf, inputs.ROBOTS))
    return out.select("domain", F.col("pos").cast("long").alias("pos"), "sitemap")


@query
def sitemap_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Of each start URL: what its robots file lists, or the default places alone."""
    from tonguemap.plans.scored_queries import starts

    begun = sitemaps.with_robots(starts(spark, sf), derive(spark, sf, inputs.ROBOTS_FETCHES))
    out = sitemaps.sitemap_candidates(begun, inputs.CFG)
    return out.select("domain", "start", F.col("pos").cast("long").alias("pos"), "url")


@query
def sitemap_locs(spark: SparkSession, sf: str) -> DataFrame:
    parsed = sitemaps.parse_sitemaps(derive(spark, sf, inputs.SITEMAPS))
    return parsed.select(
        "seq", F.when(F.col("is_index"), "sitemaps").otherwise("urls").alias("kind"), "parse_error",
        F.posexplode_outer("locs").alias("pos", "loc"),
    ).select("seq", "kind", "parse_error", F.col("pos").cast("long").alias("pos"), "loc")


@query
def sitemap_gzip_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemap payloads as they land, every other one packed, told apart by their first bytes."""
    docs = derive(spark, sf, inputs.SITEMAPS).select("url", "seq", F.col("body").cast("binary").alias("payload"))
    packed = F.when(F.col("seq") % 2 == 0, _packed("payload")).otherwise(F.col("payload"))
    return sitemaps.payload_text(docs.withColumn("payload", packed), "payload").select("url", "body")


@F.pandas_udf(T.BinaryType())
def _packed(payloads: pd.Series) -> pd.Series:
    return payloads.map(gzip.compress)


@query
def sitemap_expand(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.plans.scored_queries import discovered

    return discovered(spark, sf).sitemaps


@query
def filter_domain_urls(spark: SparkSession, sf: str) -> DataFrame:
    """URLs of sitemap documents that stay on the domain of the seed table (equi-join form)."""
    parsed = sitemaps.parse_sitemaps(derive(spark, sf, inputs.SITEMAPS))
    listed = parsed.select("domain", F.explode("locs").alias("loc"))
    return (
        listed.withColumn("url", urls.normalize(F.col("loc")))
        .withColumn("registered_domain", urls.domain_of(F.col("url"), inputs.SUFFIXES))
        .where(F.col("registered_domain") == F.col("domain"))
        .groupBy("domain", "url")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query
def fetch_ok(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, inputs.CRAWL).select("seq", crawl.fetch_ok().alias("ok"))


@query
def fetch_redirected(spark: SparkSession, sf: str) -> DataFrame:
    return derive(spark, sf, inputs.CRAWL).select("seq", crawl.fetch_redirected().alias("redirected"))


@query
def fetch_errors(spark: SparkSession, sf: str) -> DataFrame:
    failed = derive(spark, sf, inputs.FAILURES).withColumn("error", crawl.failure_label(F.col("exception")))
    return failed.select("seq", "error", crawl.error_line("page").alias("line"))


@query
def seed_build(spark: SparkSession, sf: str) -> DataFrame:
    lines = derive(spark, sf, inputs.DOMAIN_LINES).withColumnRenamed("value", "input_domain")
    return crawl.seeds(lines, cfg=inputs.CFG).select(
        "seq", "input_domain", "normalized_url", "host", "registered_domain", "error"
    )


@query
def registered_domain(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts under a table of suffix rules of all three kinds."""
    hosts = derive(spark, sf, inputs.CRAWL).select(urls.hostname(F.col("requested_url")).alias("host")).distinct()
    rules = spark.createDataFrame([(r,) for r in inputs.SUFFIXES], "rule string")
    return crawl.registered_domain_by_suffix(hosts, rules, "host").select(
        "host", "registered_domain", urls.registered_domain(F.col("host")).alias("last_two_labels")
    )


@query
def summary_from_json(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "reports-json")
    _report_documents(spark, sf).write.json(path)
    return reports.summary_from_reports(reports.read_reports(spark, path))


@query
def summary_from_csv(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.sinks.reports import language_csv, write_csv

    path = new_path(spark, "reports-csv")
    write_csv(language_csv(_report_documents(spark, sf)), path)
    return reports.summary_from_csv(reports.read_report_csv(spark, path))


@query
def summary_alias_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries written by three programs with their own column names, read as one."""
    from tonguemap.plans.site_queries import site_report

    report = site_report(spark, sf)
    n = F.col("language_count").cast("int")
    spellings = [
        F.struct(F.col("domain").alias("domain"), n.alias("languageCount"), F.col("languages").alias("languages")),
        F.struct(
            F.lit("").alias("domain"), F.col("domain").alias("DomainName"), n.alias("LanguageCount"),
            F.col("languages").alias("Languages"), F.col("review_recommended").alias("ReviewRecommended"),
        ),
        F.struct(
            F.col("domain").alias("Domain Name"), n.cast("string").alias("Language Count"),
            F.col("languages").alias("languages"), F.col("review_recommended").alias("Review Recommended"),
        ),
    ]
    path = new_path(spark, "summaries")
    kind = F.when(F.col("domain").startswith("m."), F.to_json(spellings[0]))
    kind = kind.when(F.col("domain").startswith("www."), F.to_json(spellings[1])).otherwise(F.to_json(spellings[2]))
    report.select(kind.alias("value")).write.text(path)
    return reports.normalize_summary(reports.read_summary(spark, path))


def _report_documents(spark: SparkSession, sf: str) -> DataFrame:
    from tonguemap.plans.scored_queries import documents

    return documents(spark, sf)
