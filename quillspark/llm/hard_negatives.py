"""Hard-negative mining by blocked exact products (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import loose, solid
from .vectors import FOUND, QUERIES, Best, block_count, blocks, common_length, exact_range, integers, matrix, merged, usable
from .workspace import Workspace

#: Anchors sent to the tasks at once: 8192 of 64 components are 4 MB, and what a task keeps for them 10 MB.
ANCHORS = 8192


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, id, label and vectors of a block, in ascending order of id."""
    row, ids, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "id", "label"))
    order = np.argsort(ids, kind="stable")
    return row[order], ids[order], label[order], matrix(batch.column("vec"))[order]


def best_positives(rows: DataFrame, anchors: tuple, k: int) -> DataFrame:
    """(slot, id, score, rank): for each anchor of the block the k best other rows of its label.

    ``anchors`` is (row, label, vectors) in order of slot. A task multiplies its candidates of a label with
    the anchors of that label and keeps k for each anchor.
    """
    sent = rows.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_row, a_label, a_vecs = sent.value
        best = Best(len(a_row), k)
        by_label = {y: np.flatnonzero(a_label == y) for y in np.unique(a_label)}
        for batch in blocks(batches):
            row, ids, label, vecs = _columns(batch)
            for y in np.unique(label):
                here, mine = np.flatnonzero(label == y), by_label.get(y, ())
                for lo in range(0, len(mine), QUERIES):
                    slots = mine[lo : lo + QUERIES]
                    scores = a_vecs[slots] @ vecs[here].T
                    scores[a_row[slots][:, None] == row[here][None, :]] = -np.inf
                    best.offer(slots, scores, ids[here])
        yield best.rows()

    return merged(rows.select("row", "id", "label", "vec").mapInArrow(run, FOUND), k)


def windowed_negatives(rows: DataFrame, anchors: tuple, windows: tuple, k: int) -> DataFrame:
    """(slot, id, score, rank): for each window the k best rows of another label with a score within it.

    ``windows`` is (anchor, low, high) in order of slot, ``anchor`` a place among the anchors. A block's
    products are made once and held against each anchor's first window, then its second, and so on.
    """
    sent = rows.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, a_label, a_vecs), (of, low, high) = sent.value
        best = Best(len(of), k)
        turn = np.arange(len(of)) - np.searchsorted(of, of)  # windows are in order of their anchors
        turns = [np.flatnonzero(turn == t) for t in range(turn.max(initial=-1) + 1)]
        for batch in blocks(batches):
            _, ids, label, vecs = _columns(batch)
            for lo in range(0, len(a_label), QUERIES):
                scores = a_vecs[lo : lo + QUERIES] @ vecs.T
                scores[a_label[lo : lo + QUERIES][:, None] == label[None, :]] = -np.inf
                for slots in turns:
                    slots = slots[(of[slots] >= lo) & (of[slots] < lo + QUERIES)]
                    s = scores[of[slots] - lo]
                    best.offer(slots, np.where((s >= low[slots][:, None]) & (s <= high[slots][:, None]), s, -np.inf), ids)
        yield best.rows()

    return merged(rows.select("row", "id", "label", "vec").mapInArrow(run, FOUND), k)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of each anchor's hard negatives.

    Scores are inner products of the vectors' integers floor(scale * x), exact in float64; the greatest come
    first, ties by smaller id. An anchor's positives are the best other rows of its label. The negatives of
    a positive are the best rows of another label with a score of ``least`` (a part, of so many) of the
    positive's score at least, and its score at most.

    Anchors are dealt into blocks of about ``block``. Each block is sent to every task in turn, meets the
    candidates in pieces whose products are of bounded size, and gets the best of each task back; its
    positives, at most ``positives`` an anchor, go out for the second pass. A block's result is written, so
    a lost executor costs no more than its tasks.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do vectors of
    another length than the most common one. Components are held within the range in which products are
    exact (over 11 million for 64 components). Repeated rows are rows of their own: another row of the
    anchor's id is another row. A null vec_id comes last among equal scores. Other columns are ignored. An
    empty table, or one without anchors, gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "negatives")
    kept = vectors.select(solid(vec_id).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("raw")).filter(F.col("label").isNotNull() & usable("raw"))
    length = common_length(kept, "raw")
    rows = ws.table(kept.filter(F.size("raw") == length).select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", integers("raw", scale, exact_range(length, 53)).alias("vec")))
    n = block_count(rows.filter("anchor").count(), block)
    out = []
    for b in range(n):
        mine_of = rows.filter("anchor").filter(F.pmod(F.xxhash64("id", "row"), F.lit(n)) == b)
        got = sorted(mine_of.select("row", "id", "label", "vec").collect())
        if not got:
            continue
        row, ids, y = (np.array([r[i] for r in got], np.int64) for i in range(3))
        anchors = (row, y, np.array([r.vec for r in got], np.float64).reshape(len(got), -1))
        pairs = sorted((r.slot, r["rank"], r.id, r.score) for r in best_positives(rows, anchors, positives).collect())
        if not pairs:
            continue
        of, _, who, score = (np.array(c, np.int64) for c in zip(*pairs))
        part, whole = least
        low, high = -((-part * score) // whole), score
        found = windowed_negatives(rows, anchors, (of, low.astype(np.float64), high.astype(np.float64)), negatives)
        names = spark.createDataFrame([(i, int(ids[a]), int(w), int(s)) for i, (a, w, s) in enumerate(zip(of, who, score))], "slot int, anchor_id long, positive_id long, positive_score long")
        out.append(ws.table(found.join(names, "slot").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))))
    ws.drop(rows)
    if not out:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select("anchor_id", loose("positive_id"), "rank", loose("negative_id"), "positive_score", "negative_score")


def relabelled(vec_id: str = "vec_id", label: str = "label", every: int = 7, labels: int = 10) -> Column:
    """The label, moved on by one (modulo ``labels``) where vec_id is divisible by ``every``."""
    return F.when(F.col(vec_id) % every == 0, (F.col(label) + 1) % labels).otherwise(F.col(label))


MINE_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.r <> c.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS turn
      FROM s WHERE same QUALIFY turn <= 5),
n AS (SELECT p.r, p.turn, anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.r, p.turn ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
      FROM p JOIN s USING (r, anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n
"""
