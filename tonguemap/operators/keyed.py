"""Keyed-state jobs in batch form: quotas, latest state with expiry, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonguemap.config import DEFAULT, EngineConfig
from tonguemap.functions import render
from tonguemap.functions.urls import none_if_empty
from tonguemap.operators.skew import running_count


def client_key(forwarded: Column, fallback: Column) -> Column:
    """First entry of a forwarding list, else the fallback, trimmed."""
    first = F.element_at(F.split(none_if_empty(forwarded), ","), 1)
    return F.trim(F.coalesce(first, fallback))


def quota_windows(submissions: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Submissions per key and window, with the number beyond the limit; (ts, key) in.

    A partial count per task goes ahead of the shuffle, so a hot key sends one row per window and task.
    Works on a stream as well.
    """
    n = F.count(F.lit(1))
    return submissions.groupBy(F.window("ts", cfg.quota_window).alias("w"), "key").agg(n.alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "key", "n",
        F.greatest(F.col("n") - cfg.quota_limit, F.lit(0).cast("long")).alias("rejected"),
    )


def latest_state(updates: DataFrame, ttl: str = DEFAULT.state_ttl) -> DataFrame:
    """Last update per key that is not older than ``ttl`` at the time of the newest update of all.

    ``updates`` is (key, ts, update_id, state); ties on ``ts`` go to the higher id.
    """
    last = updates.groupBy("key").agg(F.max(F.struct("ts", "update_id", "state")).alias("u")).select("key", "u.*")
    now = updates.agg(F.max("ts")).scalar()
    return last.where(F.col("ts") >= now - F.expr(f"INTERVAL {ttl}"))


def job_states(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Where each submitted job stands: (job_id, total, done, progress, status).

    ``jobs`` is (job_id, total, failed) with one row per job and the number of steps it was submitted with;
    ``steps`` has a row per finished step. A job is ``error`` when it failed, ``queued`` before its first
    step, ``complete`` when all are done, and ``running`` between. Steps are counted before they are joined.
    """
    counted = steps.groupBy("job_id").agg(F.count(F.lit(1)).alias("done"))
    joined = jobs.join(counted, "job_id", "left").withColumn("done", F.coalesce("done", F.lit(0).cast("long")))
    return counted_states(joined)


def counted_states(jobs: DataFrame) -> DataFrame:
    """Progress and status of jobs (job_id, total, done, failed)."""
    status = (
        F.when(F.col("failed"), "error").when(F.col("done") >= F.col("total"), "complete")
        .when(F.col("done") == 0, "queued").otherwise("running")
    )
    share = F.when(F.col("total") > 0, render.progress_percent(F.least("done", "total"), F.col("total"))).otherwise(100)
    return jobs.select("job_id", "total", "done", share.cast("long").alias("progress"), status.alias("status"))


def job_progress(steps: DataFrame, bucket: str = "minute") -> DataFrame:
    """Progress after every finished step of a job: (job_id, step_id, ts) in, one row per step out.

    ``bucket`` is the span of time that one task counts at once; shorter spans suit busier jobs.
    """
    bucketed = steps.withColumn("_bucket", F.date_trunc(bucket, "ts"))
    counted = running_count(bucketed, ["job_id"], "_bucket", ["ts", "step_id"], "done", "total")
    return counted.select(
        "job_id", "step_id", F.col("done").cast("long").alias("done"), "total",
        render.progress_percent(F.col("done"), F.col("total")).alias("progress"),
        F.when(F.col("done") == F.col("total"), "complete").otherwise("running").alias("status"),
    )
