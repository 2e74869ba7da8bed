"""Written intermediate tables in the folder all executors share.

A table that several jobs read is written once and read back. Unlike a cached or locally
checkpointed one it survives lost executors, keeps column pruning and push-down, and cuts lineage.
A job that has written its result inside :func:`dropping_staged` leaves none of them behind.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


_open: list[list[str]] = []  # paths of the scopes that are running, innermost last


@contextmanager
def dropping_staged(spark: SparkSession) -> Iterator[None]:
    """Drop what is staged inside, at the end: results must be written before it ends."""
    _open.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _open.pop():
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def work_dir(spark: SparkSession) -> str:
    """The session's shared folder; local sessions without one get a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    base = tempfile.mkdtemp(prefix="tonguemap-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{work_dir(spark).rstrip('/')}/tonguemap/{name}-{uuid.uuid4().hex[:12]}"
    if _open:
        _open[-1].append(path)
    return path


def stage(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet, with options of the writer, and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage the table that ``make`` gives, and drop all that it staged on the way."""
    path = new_path(spark, name)
    with dropping_staged(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*calls: Callable) -> list:
    """Results of calls that do not depend on each other, such as tables to stage; their jobs run side by side."""
    same_session = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(same_session(c)) for c in calls]]
