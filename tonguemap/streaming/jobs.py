"""The keyed-state jobs and the reports as Structured Streaming queries.

Each job reads what has arrived, keeps its progress in a checkpoint, and reduces each micro-batch to facts that merge in
any order. Facts are written by batch id to a table that is merged now and then (:mod:`tonguemap.operators.merged`),
so state is a table, late rows simply add to it, and a batch that is written again after a failure replaces its
first attempt. Give a job a ``path`` of its own to go on from where it stopped; without one it starts from nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.operators import keyed, scored, site
from tonguemap.operators.discovery import Discovery
from tonguemap.operators.merged import Merge, MergedTable
from tonguemap.operators.pages import scored_pages, site_pages
from tonguemap.operators.stage import new_path

MERGE_EVERY = 16  # batches


def run_available(
    stream: DataFrame, name: str, mode: str, prepare: Callable = lambda df: df, merge: Merge | None = None,
    path: str | None = None, every: int = MERGE_EVERY,
) -> DataFrame:
    """Process what has arrived since the last run at ``path`` and return the facts of all runs, with their ``batch``."""
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    table = MergedTable(spark, f"{path}/table", merge, every)
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .foreachBatch(lambda df, batch: table.append(prepare(df), batch))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()


def quota_windows_stream(
    submissions: DataFrame, late_by: str = "1 hour", cfg: EngineConfig = DEFAULT, path: str | None = None
) -> DataFrame:
    """Streaming quota: each batch writes the windows it changed, the last one written holds.

    State ends with the watermark, so it stays as small as the open windows.
    """
    def last(written: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct("n", "rejected"), "batch").alias("v")
        return written.groupBy("window_start", "key").agg(newest, F.max("batch").alias("batch")).select("window_start", "key", "v.*", "batch")

    changed = keyed.quota_windows(submissions.withWatermark("ts", late_by), cfg)
    return last(run_available(changed, "quota", "update", merge=last, path=path)).drop("batch")


def latest_state_stream(updates: DataFrame, ttl_seconds: int = 3600, path: str | None = None) -> DataFrame:
    """Streaming latest state per key, without the keys whose last update is ``ttl_seconds`` older than the newest of all.

    A batch brings the last update of each key, pre-aggregated per task; merging keeps the last of them and drops what has
    expired, so the table is as small as the live keys. No state store, and nothing in Python.
    """
    def live(written: DataFrame) -> DataFrame:
        last = written.groupBy("key").agg(F.max(F.struct("ts", "update_id", "state", "batch")).alias("u")).select("key", "u.*")
        return last.where(F.col("ts") >= written.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))

    def reduced(df: DataFrame) -> DataFrame:
        return df.groupBy("key").agg(F.max(F.struct("ts", "update_id", "state")).alias("u")).select("key", "u.*")

    return live(run_available(updates, "latest", "append", reduced, live, path)).drop("batch")


def job_states_stream(
    submissions: DataFrame, steps: DataFrame, timeout_seconds: int | None = None, path: str | None = None
) -> DataFrame:
    """Where each submitted job stands, from a stream of submissions (job_id, total, failed, ts) and one of finished
    steps (job_id, ts), which may come in any order.

    With ``timeout_seconds``, a job that is not complete and of which nothing was heard for so long before the newest
    event of all is an error.
    """
    none = F.lit(None)
    events = submissions.select("job_id", F.col("total").cast("long").alias("total"), "failed", F.lit(0).cast("long").alias("done"), "ts").unionByName(
        steps.select("job_id", none.cast("long").alias("total"), none.cast("boolean").alias("failed"), F.lit(1).cast("long").alias("done"), "ts"))

    def summed(df: DataFrame) -> DataFrame:
        batch = [F.max("batch").alias("batch")] if "batch" in df.columns else []
        return df.groupBy("job_id").agg(
            F.max("total").alias("total"), F.bool_or("failed").alias("failed"), F.sum("done").alias("done"), F.max("ts").alias("ts"), *batch)

    facts = run_available(events, "job-states", "append", summed, summed, path)
    jobs = summed(facts).where(F.col("total").isNotNull()).withColumn("failed", F.coalesce("failed", F.lit(False)))
    if timeout_seconds is not None:
        silent = F.col("ts") < facts.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {timeout_seconds} SECONDS")
        jobs = jobs.withColumn("failed", F.col("failed") | (silent & (F.col("done") < F.col("total"))))
    return keyed.counted_states(jobs)


def site_report_stream(crawl: DataFrame, path: str | None = None) -> DataFrame:
    """Site report over arriving fetches: each batch adds its few facts per site, the report sums them up."""
    facts = run_available(site_pages(crawl), "site-facts", "append", site.site_facts, site.merged_facts, path)
    return site.site_report(facts)


def language_report_stream(
    crawl: DataFrame, known: Discovery | None = None, cfg: EngineConfig = DEFAULT, path: str | None = None
) -> DataFrame:
    """Scored report over arriving fetches.

    Facts hold the number of marks and the first page with one, and the pages whose text speaks. What a text counts is
    decided when the report is read, so a trusted page that comes late turns warnings of later pages into points.
    """
    pages = scored_pages(crawl, cfg)
    facts = run_available(pages, "scored-facts", "append", scored.page_facts, scored.merged_facts, path)
    return scored.report_of_facts(scored.merged_facts(facts), known, cfg)


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)
