"""Tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset on one machine (tests), a new temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Spark's setting for deleting a query's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    """A folder of intermediate tables. A lost executor costs no more than the stage that it was running."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again. The shuffle files of the write go at its end."""
        self.n += 1
        at = f"{self.path}/{self.n}"
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.unset(CLEANUP) if before is None else self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quill_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for x in tables:
            if at := getattr(x, "_quill_path", None):
                self._delete(at)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete this folder's tables, but for those that are still to be read."""
        left = {getattr(x, "_quill_path", None) for x in tables}
        for i in range(1, self.n + 1):
            if (at := f"{self.path}/{i}") not in left:
                self._delete(at)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
