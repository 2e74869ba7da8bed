"""Tables that grow by batches of facts, which merge in any order, and are merged now and then.

A table is a folder. ``batch=<id>`` holds what a batch gave, ``merged/<version>`` what older batches were merged to, and
a file name in ``manifest`` says which version holds and up to which batch it goes. Readers follow the newest
manifest: that version, and all later batches.

Merging writes a version first and then its manifest, which is the switch; until then the version is not read. What
it replaces is deleted one merge later, so that a reader of the version before is not disturbed. A merge that is
killed at any point loses nothing: the next one writes the version anew, or deletes what was left. A batch that
is written again, after a failure, replaces its first attempt, or is not read if it was merged already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


class MergedTable:
    """``merge`` maps facts (with their ``batch``) to fewer facts of the same columns, by which reading gives the same."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge | None = None, every: int = 16, files: int = 8):
        self.spark, self.path, self.merge, self.every, self.files = spark, path.rstrip("/"), merge, every, files

    def append(self, facts: DataFrame, batch: int) -> None:
        """Write a batch, and merge after each ``every`` of them."""
        facts.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if self.merge is not None and len(self._batches(after=self.version()[1])) >= self.every:
            self.compact()

    def read(self) -> DataFrame:
        """All facts, with the ``batch`` that they came with; merged ones have the last of their batches."""
        version, upto = self.version()
        parts = [self.spark.read.parquet(f"{self.path}/merged/{version}")] if version else []
        later = [f"{self.path}/batch={b}" for b in self._batches(after=upto)]
        if later:
            parts.append(self.spark.read.option("basePath", self.path).parquet(*later))
        out = parts[0].withColumn("batch", F.col("batch").cast("long"))
        return out.unionByName(parts[1].withColumn("batch", F.col("batch").cast("long"))) if parts[1:] else out

    def compact(self) -> None:
        """Merge all batches that are there."""
        version, upto = self.version()
        batches = self._batches(after=upto)
        if not batches:
            return
        merged = self.merge(self.read()).coalesce(self.files)
        merged.write.mode("overwrite").parquet(f"{self.path}/merged/{version + 1}")
        self._switch(version + 1, batches[-1])
        for batch in self._batches(upto=upto):
            self._delete(f"{self.path}/batch={batch}")
        for name in self._names("merged"):
            if int(name) < version:
                self._delete(f"{self.path}/merged/{name}")
        for name in self._names("manifest"):
            if int(name.split("-")[0]) < version:
                self._delete(f"{self.path}/manifest/{name}")

    def version(self) -> tuple[int, int]:
        """The version that holds, and its last batch; (0, -1) before the first merge."""
        said = [tuple(map(int, name.split("-"))) for name in self._names("manifest")]
        return max(said, default=(0, -1))

    def _switch(self, version: int, upto: int) -> None:
        self._fs().create(self._jvm_path(f"{self.path}/manifest/{version}-{upto}"), False).close()

    def _batches(self, after: int = -1, upto: int | None = None) -> list[int]:
        """Batches that are written in full, in order."""
        found = sorted(int(n.removeprefix("batch=")) for n in self._names("") if n.startswith("batch="))
        fs = self._fs()
        wanted = [b for b in found if b > after and (upto is None or b <= upto)]
        return [b for b in wanted if fs.exists(self._jvm_path(f"{self.path}/batch={b}/_SUCCESS"))]

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._jvm_path(f"{self.path}/{folder}" if folder else self.path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _delete(self, path: str) -> None:
        self._fs().delete(self._jvm_path(path), True)

    def _jvm_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._jvm_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
