"""Exact top-k inner product search over buckets of vectors by length (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import loose, solid
from .vectors import BLOCK, FOUND, QUERIES, Best, block_count, common_length, exact_range, integers, matrix, merged, usable
from .workspace import Workspace

#: Queries sent to the tasks at once: 8192 of 64 components are 4 MB.
QUERY_BLOCK = 8192
#: Vectors of a slice, a run of lengths that one task sorts; a slice's buckets are ``BLOCK`` vectors each.
SLICE = 65_536
#: The longest vectors, with which every query is multiplied first: its k-th best product bounds what it can still use.
LONGEST = 2048
#: A query prunes a bucket by coordinates if its local threshold, a cosine, is at least this, and by length else.
BY_COORDINATES = 0.6
#: Coordinates of a query, its largest, whose intervals are intersected.
FOCUS = 4
#: What float64 may have lost in a cosine.
SLACK = 1e-9


def _seeds(queries: DataFrame, longest: list, k: int) -> DataFrame:
    """``queries`` with ``floor``, the k-th best product with the longest vectors; null with fewer than k."""
    sent = queries.sparkSession.sparkContext.broadcast((np.array([r.row for r in longest], np.int64), np.array([r.vec for r in longest], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, vecs = sent.value
        for batch in batches:
            floor = np.full(batch.num_rows, -np.inf)
            for lo in range(0, batch.num_rows if len(row) else 0, QUERIES):
                some = batch.slice(lo, QUERIES)
                scores = matrix(some.column("vec")) @ vecs.T
                scores[some.column("row").to_numpy()[:, None] == row[None, :]] = -np.inf
                if scores.shape[1] >= k:
                    floor[lo : lo + len(scores)] = np.partition(scores, -k, axis=1)[:, -k]
            known = np.isfinite(floor)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), batch.column("vec"), pa.array(np.where(known, floor, 0).astype(np.int64), mask=~known)], ["row", "id", "vec", "floor"])

    return queries.select("row", "id", "vec").mapInArrow(run, "row long, id long, vec array<int>, floor long")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """row, id, length and vectors of runs of ``BLOCK`` rows of one slice; the rows come longest first."""
    left: list[tuple] = []

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(c) for c in zip(*(x[1:] for x in left)))

    for batch in batches:
        slices = batch.column("slice").to_numpy()
        edges = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(slices)]
        for a, b in zip(edges, edges[1:]):
            while a < b:
                if left and (left[0][0] != slices[a] or sum(len(x[1]) for x in left) == BLOCK):
                    yield whole()
                    left = []
                some = batch.slice(a, min(b - a, BLOCK - sum(len(x[1]) for x in left)))
                left.append((slices[a], some.column("row").to_numpy(), some.column("id").to_numpy(), np.sqrt(some.column("norm2").to_numpy()), matrix(some.column("vec"))))
                a += some.num_rows
    if left:
        yield whole()


def search_bucket(best: Best, queries: tuple, floors: np.ndarray, bucket: tuple) -> tuple[int, int, int]:
    """Offer a bucket's vectors to the queries that may use them; queries that left it out, and those that pruned it by coordinates and by length.

    A query's threshold is the k-th best product that it knows of, from the longest vectors or from this
    task. Over its length and the bucket's greatest length that is a cosine, the local threshold:

    - over 1, no vector of the bucket can reach it;
    - high, a vector that reaches it has each coordinate (of its direction) in an interval around the
      query's; the query's focus coordinates look up their intervals in sorted lists, and the vectors of the
      shortest one that lie in all others are verified;
    - low, only length prunes: vectors are verified as far as a vector in the query's own direction reaches it;
    - zero or less, or a query of length 0: all vectors are verified.
    """
    q_row, q_len, q_vecs, q_unit, q_focus = queries
    row, ids, length, vecs = bucket
    slots = np.arange(len(q_row))
    known = np.maximum(floors, best.scores[:, -1])
    least = float(length.min())
    with np.errstate(divide="ignore", invalid="ignore"):
        local = known / (q_len * float(length.max()))
    local[~np.isfinite(local)] = -1.0  # no threshold, or a length of 0
    reach = local <= 1 + SLACK
    coords = slots[reach & (local >= BY_COORDINATES)] if least > 0 else slots[:0]
    rest = np.setdiff1d(slots[reach], coords, assume_unique=True)

    def verify(who: np.ndarray, some: np.ndarray) -> None:
        some = some[np.argsort(ids[some], kind="stable")]
        for lo in range(0, len(who), QUERIES):
            mine = who[lo : lo + QUERIES]
            scores = q_vecs[mine] @ vecs[some].T
            scores[q_row[mine][:, None] == row[some][None, :]] = -np.inf
            best.offer(mine, scores, ids[some])

    if len(rest):
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(local[rest] > 0, known[rest] / q_len[rest] * (1 - SLACK), -1.0)
        # Lengths fall, so a query verifies a head of the bucket; queries of one BLOCK share the longest head.
        heads = np.searchsorted(-length, -needed, side="right")
        rest, heads = rest[np.argsort(heads, kind="stable")], np.sort(heads)
        for lo in range(0, len(rest), QUERIES):
            verify(rest[lo : lo + QUERIES], np.arange(heads[lo : lo + QUERIES].max()))
    if len(coords):
        unit = vecs / length[:, None]
        lists: dict[int, tuple] = {}
        for s in coords:
            t, c = min(local[s] * (1 - SLACK), 1.0), q_unit[s, q_focus[s]]
            spread = np.sqrt(np.maximum(0, (1 - t * t) * (1 - c * c)))
            low, high = np.where(c < -t, -1.0, c * t - spread) - SLACK, np.where(c > t, 1.0, c * t + spread) + SLACK
            spans = []
            for f, a, b in zip(q_focus[s], low, high):
                if f not in lists:
                    order = np.argsort(unit[:, f], kind="stable")
                    lists[f] = (order, unit[order, f])
                order, values = lists[f]
                spans.append((np.searchsorted(values, a, "left"), np.searchsorted(values, b, "right")))
            i = int(np.argmin([b - a for a, b in spans]))
            some = lists[q_focus[s][i]][0][slice(*spans[i])]
            inside = unit[some][:, q_focus[s]]
            some = some[((inside >= low) & (inside <= high)).all(axis=1)]
            if len(some):
                verify(np.array([s]), some)
    return int((~reach).sum()), len(coords), len(rest)


def _search(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """(slot, id, score, rank) of a block of queries over the sliced rows."""
    vecs = np.array([r.vec for r in queries], np.float64)
    floors = np.array([-np.inf if r.floor is None else r.floor for r in queries], np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r.row for r in queries], np.int64), vecs, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_row, q_vecs, floors = sent.value
        q_len = np.sqrt((q_vecs * q_vecs).sum(axis=1))
        q_unit = q_vecs / np.maximum(q_len, 1)[:, None]
        focus = np.argsort(-np.abs(q_unit), axis=1, kind="stable")[:, :FOCUS]
        best = Best(len(q_row), k)
        for bucket in _buckets(batches):
            search_bucket(best, (q_row, q_len, q_vecs, q_unit, focus), floors, bucket)
        yield best.rows()

    return merged(rows.select("slice", "row", "id", "norm2", "vec").mapInArrow(run, FOUND), k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = QUERY_BLOCK, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of greatest inner product with each query, itself left out.

    Products are those of the vectors' integers floor(scale * x), exact in float64; ties go to the smaller
    id. Vectors are sorted by length into slices and their buckets (``search_bucket``), so a task holds
    vectors of like length; equal lengths are dealt on by row, so any number of them is split. Blocks of
    queries are sent to all tasks in turn, and each task gives its k best for a query back. No vector is
    left out but by a bound that shows it can't be among the k best.

    Null vectors and those with a null or non-finite component take no part, nor do vectors of another
    length (in components) than the most common one. Components are held within the range in which products
    are exact (over 11 million for 64 components). Repeated rows are rows of their own: another row of the
    query's id is a candidate. A null vec_id comes last among equal scores. Zero vectors have score 0 with
    all. Other columns are ignored. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "products")
    kept = vectors.select(solid(vec_id).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("raw")).filter(usable("raw"))
    length = common_length(kept, "raw")
    norm2 = F.aggregate("vec", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    rows = ws.table(kept.filter(F.size("raw") == length).select(F.monotonically_increasing_id().alias("row"), "id", "asks", integers("raw", scale, exact_range(length, 53)).alias("vec")).withColumn("norm2", norm2))
    sliced = rows.repartitionByRange(block_count(rows.count(), slice_rows), F.desc("norm2"), "row").sortWithinPartitions(F.desc("norm2"), "row")
    sliced = ws.table(sliced.withColumn("slice", F.spark_partition_id()))
    longest = rows.orderBy(F.desc("norm2"), "row").limit(LONGEST).select("row", "vec").collect()
    asked = ws.table(_seeds(rows.filter("asks"), longest, k))
    ws.drop(rows)
    n = block_count(asked.count(), block)
    out = []
    for b in range(n):
        queries = sorted(asked.filter(F.pmod(F.xxhash64("id", "row"), F.lit(n)) == b).collect())
        if not queries:
            continue
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(queries)], "slot int, query_id long")
        out.append(ws.table(_search(sliced, queries, k).join(names, "slot").select("query_id", "rank", F.col("id").alias("vec_id"), "score")))
    ws.drop(sliced, asked)
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result.select("query_id", "rank", loose("vec_id"), "score")


SEARCH_SQL = """
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER (PARTITION BY q.r ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id NULLS LAST))::INTEGER AS rank,
       c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""
