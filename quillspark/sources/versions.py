"""Tables in whole versions: a folder a version, which counts once its writer's mark is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Versions of a few tables that change together, with the last id that they have taken in.

    A version is written table by table and at last its mark, a row (version, last_id). A writer that is lost
    before the mark leaves nothing that is read, and its version is written anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def latest(self) -> int:
        """The number of the last whole version; 0 for none."""
        fs, root = self._fs(self.path)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        numbers = sorted((int(n[len("version=") :]) for n in names if n.startswith("version=")), reverse=True)
        return next((n for n in numbers if self._whole(n)), 0)

    def _whole(self, version: int) -> bool:
        fs, done = self._fs(f"{self.path}/version={version}/mark/_SUCCESS")
        return fs.exists(done)

    def last_id(self, version: int | None = None) -> int | None:
        """The greatest id that the version has taken in; None before the first."""
        version = self.latest() if version is None else version
        return self.spark.read.schema("version long, last_id long").parquet(f"{self.path}/version={version}/mark").first().last_id if version else None

    def read(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        """A table of a version, the latest if none is named; empty before the first."""
        version = self.latest() if version is None else version
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={version}/{name}") if version else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, DataFrame], last_id: int | None) -> int:
        """Write the next version; its number."""
        version = self.latest() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/version={version}/{name}")
        mark = self.spark.createDataFrame([(version, last_id)], "version long, last_id long")
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}/mark")
        return version

    def drop_before(self, version: int) -> None:
        """Delete the versions before this one."""
        for n in range(1, version):
            fs, old = self._fs(f"{self.path}/version={n}")
            fs.delete(old, True)


def new_rows(rows: DataFrame, key: str, last_id: int | None) -> DataFrame:
    """Rows after the last id that was read; the bound reaches a Parquet scan as a filter."""
    return rows if last_id is None else rows.filter(f"{key} > {int(last_id)}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir."""
    from quillspark.operators.graphs import shared_folder

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
