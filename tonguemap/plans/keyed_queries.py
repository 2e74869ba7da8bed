"""Queries of the keyed-state jobs, in batch and as streams."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT
from tonguemap.operators import keyed
from tonguemap.operators.stage import stage
from tonguemap.plans import inputs
from tonguemap.plans.inputs import derive
from tonguemap.plans.registry import query
from tonguemap.plans.scored_queries import discovered
from tonguemap.streaming import jobs

# a limit that binds on the given events
QUOTA = replace(DEFAULT, quota_limit=3)


def _keyed(submissions: DataFrame) -> DataFrame:
    return submissions.select(
        F.col("ts").cast("timestamp").alias("ts"), keyed.client_key(F.col("forwarded"), F.col("fallback")).alias("key")
    )


def _updates(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("update_id"), F.col("event_type").alias("state"),
    )


def _crawl_stream(spark: SparkSession, sf: str) -> DataFrame:
    given = inputs.table_stream(spark, sf, "pages").selectExpr("page_id", f"{inputs.URL} AS url", "html")
    return spark.sql(inputs.CRAWL.format(pages="{given}"), given=given)


@query
def quota_windows(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.quota_windows(_keyed(derive(spark, sf, inputs.SUBMISSIONS)), QUOTA)


@query
def quota_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    stream = spark.sql(inputs.SUBMISSIONS.format(events="{given}"), given=inputs.table_stream(spark, sf, "events"))
    return jobs.quota_windows_stream(_keyed(stream), cfg=QUOTA)


@query
def latest_state_ttl(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(keyed.latest_state(_updates(inputs.table(spark, sf, "events"))))


@query
def latest_state_ttl_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(jobs.latest_state_stream(_updates(inputs.table_stream(spark, sf, "events"))))


def _shown(states: DataFrame) -> DataFrame:
    return states.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"), "update_id", "state")


@query
def job_progress(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.job_progress(
        inputs.table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("step_id"), "ts")
    )


@query
def job_states(spark: SparkSession, sf: str) -> DataFrame:
    """Users as jobs of as many steps as they have purchases, or one more; some fail and some have not begun."""
    return keyed.job_states(*_jobs(inputs.table(spark, sf, "events")))


def _jobs(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions and finished steps."""
    user = F.col("user_id").alias("job_id")
    submitted = events.groupBy(user).agg(
        (F.count_if(F.col("event_type").isin("purchase")) + F.max(F.col("user_id") % 2)).alias("total"),
        F.bool_or(F.col("user_id") % 5 == 0).alias("failed"), F.min(F.col("ts").cast("timestamp")).alias("ts"),
    )
    steps = events.where("event_type = 'purchase' AND user_id % 4 <> 3").select(user, F.col("ts").cast("timestamp").alias("ts"))
    return submitted, steps


@query
def job_states_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same from two streams, of submissions and of steps."""
    streams = []
    for df, name in zip(_jobs(inputs.table(spark, sf, "events")), ("submissions", "steps")):
        landed = stage(df, name)
        streams.append(jobs.read_stream(spark, landed.inputFiles()[0].rsplit("/", 1)[0], landed.schema))
    return jobs.job_states_stream(*streams)


@query
def site_report_stream(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.site_report_stream(_crawl_stream(spark, sf))


@query
def language_report_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The scored report over arriving fetches, with what discovery found before."""
    out = jobs.language_report_stream(_crawl_stream(spark, sf), discovered(spark, sf), inputs.CFG)
    return out.withColumn("languages", F.array_join("languages", "; "))
