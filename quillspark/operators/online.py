"""Models that learn from feedback row by row, kept in versions with the last feedback that they have seen."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.versions import Versions, new_rows

from .fusion import BINS, SMOOTHED

MODELS = "key string, updates long, weights array<double>, bias array<double>"
_HALF = SMOOTHED // 2


def smoothed(scores: np.ndarray) -> np.ndarray:
    """The moving average of a row of scores, edges repeated."""
    sums = np.cumsum(np.concatenate([[0.0], np.pad(scores, _HALF, mode="edge")]))
    return (sums[SMOOTHED:] - sums[:-SMOOTHED]) / SMOOTHED


def chances(weights: np.ndarray, bias: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The chance of each mixing weight for a vector."""
    s = smoothed(weights @ vector + bias)
    p = np.exp(s - s.max())
    return p / p.sum()


def learn(weights: np.ndarray, bias: np.ndarray, vector: np.ndarray, alpha: float, reward: float, rate: float) -> bool:
    """One step, in place: towards the weight that was used if it was rewarded, else towards one half; False for no reward."""
    if abs(reward) < 1e-6:
        return False
    target = min(BINS - 1, max(0, round(alpha * (BINS - 1)))) if reward > 0 else BINS // 2
    error = -chances(weights, bias, vector)
    error[target] += 1.0
    step = rate * abs(reward) * smoothed(error)
    weights += np.outer(step, vector)
    bias += step
    return True


def fold(models: DataFrame, feedback: DataFrame, dim: int, rate: float = 0.001) -> DataFrame:
    """Models (key, updates, weights, bias) after feedback (key, id, embedding, alpha, reward), each model in order of id.

    A step needs the one before it, so a model's feedback goes through one task, but as a stream: rows are
    dealt by key and sorted, and the task holds one model and one Arrow batch. Models of different keys
    learn side by side. A model that is new starts from zeros. Feedback without a reward, an alpha or a
    vector of ``dim`` components changes nothing; a null key is a key. Equal ids go in order of alpha,
    reward and vector.
    """
    first = models.select("key", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("double").alias("alpha"), F.lit(None).cast("double").alias("reward"), "updates", "weights", "bias")
    none = lambda kind: F.lit(None).cast(kind)
    rest = feedback.select(F.col("key").cast("string").alias("key"), F.lit(1).alias("turn"), F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("alpha").cast("double").alias("alpha"), F.col("reward").cast("double").alias("reward"), none("long").alias("updates"), none("array<double>").alias("weights"), none("array<double>").alias("bias"))
    rows = first.unionByName(rest).repartition("key").sortWithinPartitions("key", "turn", "id", "alpha", "reward", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([updates]), pa.array([weights.ravel()], pa.list_(pa.float64())), pa.array([bias], pa.list_(pa.float64()))], ["key", "updates", "weights", "bias"])

        begun, now, updates, weights, bias = False, None, 0, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["key"] != now:
                    if begun:
                        yield out()
                    begun, now, updates, weights, bias = True, r["key"], 0, np.zeros((BINS, dim)), np.zeros(BINS)
                if r["turn"] == 0:
                    updates, weights, bias = r["updates"], np.array(r["weights"], np.float64).reshape(BINS, dim), np.array(r["bias"], np.float64)
                elif r["reward"] is not None and r["alpha"] is not None and r["embedding"] is not None and len(r["embedding"]) == dim:
                    updates += learn(weights, bias, np.array(r["embedding"], np.float64), r["alpha"], r["reward"], rate)
        if begun:
            yield out()

    return rows.mapInArrow(run, MODELS)


class AlphaModels:
    """Mixing-weight models by key that feedback updates, one version an update.

    ``update`` takes the feedback after the last id that the latest version has seen, so giving it the same
    rows again, as a restarted stream does with its last batch, changes nothing. Ids must grow with time.
    As a sink of a stream: ``writeStream.foreachBatch(lambda batch, _: models.update(batch))``.
    """

    def __init__(self, versions: Versions, dim: int, rate: float = 0.001):
        self.versions, self.dim, self.rate = versions, dim, rate

    def latest(self) -> DataFrame:
        return self.versions.read("models", MODELS)

    def update(self, feedback: DataFrame) -> int:
        """The version after this feedback; the latest one if there is nothing new."""
        version = self.versions.latest()
        new = new_rows(feedback.filter("id IS NOT NULL"), "id", self.versions.last_id(version))
        last = new.agg(F.max("id")).first()[0]
        if last is None:
            return version
        return self.versions.write({"models": fold(self.latest(), new, self.dim, self.rate)}, last)

    def predict(self, vectors: DataFrame) -> DataFrame:
        """(key, vec_id, alpha): the expected mixing weight of vectors (key, vec_id, embedding) under their key's model; one half without a model or for another dimension.

        Vectors are dealt and sorted by key behind their model, so a task holds one model at a time.
        """
        dim, grid = self.dim, np.linspace(0, 1, BINS)
        model = self.latest().select("key", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<float>").alias("embedding"), "weights", "bias")
        none = F.lit(None).cast("array<double>")
        rows = model.unionByName(vectors.select(F.col("key").cast("string").alias("key"), F.lit(1).alias("turn"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), none.alias("weights"), none.alias("bias")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begun, now, weights, bias = False, None, None, None
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if not begun or r["key"] != now:
                        begun, now, weights, bias = True, r["key"], None, None
                    if r["turn"] == 0:
                        weights, bias = np.array(r["weights"]).reshape(BINS, dim), np.array(r["bias"])
                        continue
                    known = weights is not None and r["embedding"] is not None and len(r["embedding"]) == dim
                    out.append((r["key"], r["vec_id"], float(chances(weights, bias, np.array(r["embedding"], np.float64)) @ grid) if known else 0.5))
                keys, ids, alphas = zip(*out) if out else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(alphas, pa.float64())], ["key", "vec_id", "alpha"])

        return rows.repartition("key").sortWithinPartitions("key", "turn").mapInArrow(run, "key string, vec_id long, alpha double")
