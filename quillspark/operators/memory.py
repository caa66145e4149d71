"""A memory of what was said: an index of rows with vectors, additions that wait beside it, and recall over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.versions import Versions, new_rows

from .retrieval import dense, l2_normalise, top_k

ROWS = "id long, role string, content string, reward long, embedding array<double>"


class Memory:
    """Rows (id, role, content, reward, embedding) that queries recall by the dot product of normalised vectors.

    Additions are appended to a log, whose ids grow. The index is a version of all rows up to an id, with
    their vectors normalised; what the log holds beyond that id is pending. ``add`` builds the next index
    once ``rebuild_at`` rows are pending, from the last one and the pending rows alone. A recall reads the
    index and the pending rows, so it finds what a full rebuild would. A row whose id isn't beyond the
    greatest id of the log is refused by ``add``, as it was added before.
    """

    def __init__(self, spark, path: str, rebuild_at: int = 10):
        self.spark, self.rebuild_at = spark, rebuild_at
        self.versions, self.log_path = Versions(spark, f"{path}/index"), f"{path}/log"

    def log(self) -> DataFrame:
        fs, at = self.versions._fs(self.log_path)
        return self.spark.read.schema(ROWS).parquet(self.log_path) if fs.exists(at) else self.spark.createDataFrame([], ROWS)

    def add(self, rows: DataFrame) -> int:
        """Append rows that are new; the number of pending rows after that and after a rebuild, if it was due."""
        names = [c.split()[0] for c in ROWS.split(", ")]
        last = self.log().agg(F.max("id")).first()[0]
        cast = [F.col(c).cast(t).alias(c) for c, t in (f.split() for f in ROWS.split(", "))]
        new_rows(rows.select(*cast).filter("id IS NOT NULL"), "id", last).select(*names).write.mode("append").parquet(self.log_path)
        if (n := self.pending().count()) < self.rebuild_at:
            return n
        self.rebuild()
        return 0

    def pending(self) -> DataFrame:
        return new_rows(self.log(), "id", self.versions.last_id())

    def rebuild(self) -> int:
        """The next version of the index: the last one with the pending rows, normalised."""
        pending = self.pending()
        last = pending.agg(F.max("id")).first()[0]
        if last is None:
            return self.versions.latest()
        pending = pending.filter(F.col("id") <= last)  # what is added meanwhile waits for the next version
        return self.versions.write({"rows": self.versions.read("rows", ROWS).unionByName(self._normalised(pending))}, last)

    @staticmethod
    def _normalised(rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", l2_normalise(F.col("embedding")))

    def rows(self) -> DataFrame:
        """The index and the pending rows, normalised."""
        return self.versions.read("rows", ROWS).unionByName(self._normalised(self.pending()))

    def recall(self, queries: DataFrame, k: int = 4, least: float | None = None, reward: int | None = None, itself: bool = True) -> DataFrame:
        """(query_id, id, role, content, reward, score, rank): the k rows nearest to each query (query_id, embedding).

        With ``reward``, among rows rated so or better; with ``least``, of that score or more; without
        ``itself``, a query doesn't find the row of its own id.
        """
        rows = self.rows()
        rows = rows if reward is None else rows.filter(F.col("reward") >= reward)
        asked = queries.select("query_id", l2_normalise(F.col("embedding")).alias("embedding"))
        hits = dense(rows.select(F.col("id").alias("vec_id"), "embedding"), asked, k if itself else k + 1)
        if not itself:
            hits = top_k(hits.filter("query_id <> vec_id").drop("rank"), "query_id", "vec_id", k)
        if least is not None:
            hits = hits.filter(F.col("score") >= least)
        return hits.withColumnRenamed("vec_id", "id").join(rows.select("id", "role", "content", "reward"), "id").select("query_id", "id", "role", "content", "reward", "score", "rank")
