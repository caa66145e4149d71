"""Integer vectors, and the best scores of many queries kept up as candidates come in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ids import NO_ID

#: Rows of a block of candidates, and queries that are scored against it at once: 2048 x 2048 products are 32 MB.
BLOCK, QUERIES = 2048, 2048


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: str, scale: int, most: int) -> Column:
    """floor(scale * x) of each component x, as double; beyond ``most`` on either side it is ``most``."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(most)), F.lit(-most)).cast("int"))


def common_length(df: DataFrame, vector: str) -> int:
    """The length that most vectors have, the greater among equals; 0 without rows."""
    best = df.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return best["length"] if best else 0


def exact_range(length: int, bits: int) -> int:
    """The greatest component of which ``length`` products add up below 2^bits; an int32 at most."""
    return min((1 << 31) - 1, int((((1 << bits) - 1) / max(1, length)) ** 0.5))


def block_count(n: int, size: int) -> int:
    return max(1, -(-n // size))


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of ``size`` rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, size):
            yield batch.slice(lo, size)


class Best:
    """The k best (score, id) of each slot: higher scores first, ties by smaller id.

    Scores are whole numbers in float64; -inf stands for a candidate that a slot doesn't take. Offers of
    two halves of the candidates can be merged by a sort of what both kept.
    """

    def __init__(self, slots: int, k: int):
        self.k = k
        self.scores = np.full((slots, k), -np.inf)
        self.ids = np.full((slots, k), NO_ID, np.int64)

    def offer(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of ``slots`` (rows, each slot once) by candidates (columns, in ascending order of ``ids``)."""
        if not scores.size:
            return
        top, least = scores.max(axis=1), self.scores[slots, -1]
        live = np.flatnonzero((top > -np.inf) & (top >= least))
        if not len(live):
            return
        scores, least, slots = scores[live], least[live], slots[live]
        bar = least
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1])
        bar = bar[:, None]
        tie = (scores == bar) & (bar > -np.inf)
        tie &= np.cumsum(tie, axis=1) <= self.k  # of equal scores the first ids are enough
        row, col = np.nonzero((scores > bar) | tie)
        n = len(slots)
        at = np.concatenate([np.repeat(np.arange(n), self.k), row])
        score = np.concatenate([self.scores[slots].ravel(), scores[row, col]])
        who = np.concatenate([self.ids[slots].ravel(), ids[col]])
        order = np.lexsort((who, -score, at))
        place = np.arange(len(order)) - np.searchsorted(at[order], np.arange(n))[at[order]]
        keep = order[place < self.k]  # every slot has k of them, as its old ones are there
        self.scores[slots] = score[keep].reshape(n, self.k)
        self.ids[slots] = who[keep].reshape(n, self.k)

    def rows(self) -> pa.RecordBatch:
        """(slot, id, score) of what the slots hold."""
        slot, place = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(self.ids[slot, place]), pa.array(self.scores[slot, place].astype(np.int64))], ["slot", "id", "score"])


#: Schema of ``Best.rows``.
FOUND = "slot int, id long, score long"


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each slot of what the tasks kept, with their rank from 1."""
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
