"""Mixing sources to target weights (operator 2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Ranges of the random key: its first three hex digits.
RANGE_DIGITS = 3


def word_count(text):
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """skey, source_size and target for totals (skey, source, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. With
    sources in order of cap * size / weight, the level is the first that its source can bear: sources before
    it take their cap, it and the rest their weight times the level. One row a source is sorted.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    t = t.withColumn("most", cap * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    share = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("level", rest / share).withColumn("turn", F.row_number().over(by_ratio))
    t = t.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("turn"))).over(everything))
    return t.select("skey", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def random_key(seed: int = 0) -> Column:
    """A hash of a row's doc_id and text: with the text, as many rows may share a doc_id, null among them."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), part("doc_id"), F.lit(":"), part("text")))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken (and ``carry``: slim columns that tell rows of one doc_id apart) for each document.

    Each source's documents are dealt by ranges of a random key and sorted in each range. The sums of the
    ranges, then those within a range, give each document's first word in its source's order. A source's
    budget (the whole words of its target) takes whole epochs and then the head of that order; the document
    at the cut is taken in part. So a source takes its budget exactly, and no document over ``cap`` times.

    Null and blank texts have size 0 and are never taken. A null source is one source. Repeated rows each
    count. Other columns are ignored. An empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "mix")
    extra = [c for c in carry if c != "doc_id"]
    key = random_key(seed)
    skey = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    slim = docs.select("doc_id", "source", *(c for c in carry if c not in ("doc_id", "source")), skey.alias("skey"), key.alias("key"), word_count(F.col("text")).alias("size")).withColumn("bucket", F.substring("key", 1, RANGE_DIGITS))
    slim = ws.table(slim)
    ranges = ws.table(slim.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("words")))
    goals = targets(ranges.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = ranges.select("skey", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start")).join(goals, "skey")
    inside = Window.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.join(start, ["skey", "bucket"]).withColumn("first", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    head = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), head - F.col("first")))
    return rows.select("doc_id", *extra, "size", "source_size", "target", taken.cast("long").alias("taken"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS most FROM s),
r AS (
  SELECT *, row_number() OVER o AS turn,
         (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM w
  WINDOW o AS (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS FIRST),
         b AS (ORDER BY most::DOUBLE / weight::DOUBLE, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size,
         least(most::DOUBLE, (SELECT arg_min(level, turn) FROM r WHERE level <= most::DOUBLE / weight::DOUBLE) * weight) AS target
  FROM r),
p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - first)))::BIGINT AS taken
FROM p
"""
