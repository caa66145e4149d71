"""Document ids in operators that join, group or hand them to numpy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

#: Stands for a null doc_id, which is one id and the largest.
NO_ID = (1 << 63) - 1


def solid(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def loose(column: str = "doc_id") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def keyed(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, key, row): doc_id and key name one row, whose columns are in ``row``.

    The key is empty where a doc_id is of one row. Rows that share one, null among them, are written with
    a 128-bit hash of the row and a number that tells equal rows apart, so that a key never changes.
    """
    rows = docs.select(solid(), F.struct(*docs.columns).alias("row"))
    once = F.lit("").alias("key")
    shared = ws.table(docs.select(solid()).groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if shared.isEmpty():
        return rows.select("doc_id", once, "row")
    key = F.concat(F.md5(F.to_json("row")), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")).alias("key")
    again = ws.table(rows.join(shared, "doc_id", "left_semi").select("doc_id", key, "row"))
    return rows.join(shared, "doc_id", "left_anti").select("doc_id", once, "row").unionByName(again)
