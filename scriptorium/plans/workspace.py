"""Tables in the shared folder, to cut lineage between the steps of one query.

A step that later steps read more than once, or that an iteration builds on, is
written as Parquet and read again. The files lie in the folder that the cluster
names in ``spark.checkpoint.dir``, so every executor reaches them and losing an
executor costs no more than the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files of a finished write go at once; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode, without that setting, a folder of this machine.

    Raises ValueError on a cluster that names no folder.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="scriptorium-")
    return f"file://{_local_dir}"


class Workspace:
    """A folder of its own for the tables of one query. It goes when the session's JVM ends."""

    def __init__(self, spark: SparkSession, label: str = "ws"):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._names = 0
        fs, path = self._fs(self.path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str, arrow_rows: int | None = None) -> DataFrame:
        """Write ``df`` and return the written table; its shuffle files go when it is written.

        arrow_rows: rows that go to Python at a time while this is written, fewer where
        a row holds long texts. The session's own settings come back afterwards.
        """
        self._names += 1
        path = f"{self.path}/{self._names:03d}-{name}"
        ours = {CLEANUP: "true"} | ({ARROW_ROWS: str(arrow_rows)} if arrow_rows else {})
        before = {key: self.spark.conf.get(key) for key in ours}
        try:
            for key, value in ours.items():
                self.spark.conf.set(key, value)
            df.write.mode("overwrite").parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path  # for drop()
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table written by save() that nothing will read again."""
        fs, path = self._fs(df._workspace_path)
        fs.delete(path, True)

    def clear(self) -> None:
        """Remove all tables, which nothing will read again."""
        fs, path = self._fs(self.path)
        fs.delete(path, True)
