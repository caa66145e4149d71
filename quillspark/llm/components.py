"""Distributed union-find over links, shared by the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _stars(edges: DataFrame) -> bool:
    """Whether each node is the larger end of one edge and of no more, or the smaller end of any number."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("low")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("low").alias("low")).filter("n + low > 1").isEmpty()


def connected(links: DataFrame, ws: Workspace) -> DataFrame:
    """(node, label) for each node of the links (u, v): label is the smallest node of its component.

    Alternates the large-star and small-star steps: every node hands its larger neighbours, then its
    smaller ones, to the smallest node that it knows. Each step is a grouped minimum and a join, so a
    node with many links is split by the shuffle's partial aggregates and skew handling, and no list of
    neighbours is gathered. The rounds grow with the logarithm of the longest chain. Each round's links
    are written to the shared folder, which cuts the lineage. It ends when all that is left is stars, which
    are around the smallest nodes, as every edge points from the larger end to the smaller.
    """
    edges = ws.table(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        after = ws.table(small)
        ws.drop(edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
