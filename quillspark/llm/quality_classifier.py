"""Quality classifier: random Fourier features, ridge by normal equations, isotonic calibration (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .folds import held_out, labelled_sample
from .workspace import Workspace

MAX_LABELLED = 30_000
FOURIER = 256
PARTS = 8
CUT = 0.7
_COUNTED = [np.isin(np.arange(256), list(x)) for x in (b"#*$%&<>", b"!", b"|", b".,;:?", b"0123456789", range(65, 91), range(128, 256))]
N_STATISTICS = 8 + len(_COUNTED)


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offsets])


def _repeats(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each row's hashes equal another one of the row that comes before it in order."""
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n).astype(np.uint64)
    keys = np.sort((row << np.uint64(48)) | (hashes >> np.uint64(16)))
    again = np.flatnonzero(keys[1:] == keys[:-1]) + 1
    return np.bincount((keys[again] >> np.uint64(48)).astype(np.int64), minlength=len(n))


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``N_STATISTICS`` numbers for each text of a slice."""
    starts, ends, first = kernels.runs(data, offsets, kernels.NOT_SPACE)
    n = np.diff(first)
    words = np.maximum(n, 1)
    hashes = kernels.run_hashes(data, starts, ends)
    five = hashes.copy()
    for k in range(1, 5):
        five[:-k] = kernels.mixed(five[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]) if k < len(five) else five[:-k]
    row = np.repeat(np.arange(len(n)), n)
    whole = np.arange(len(starts)) + 5 <= first[1:][row]
    windows = np.concatenate([[0], np.cumsum(whole)])[first]
    is_line = np.ones(256, bool)
    is_line[10] = False
    l_starts, l_ends, l_first = kernels.runs(data, offsets, is_line)
    lines = np.maximum(np.diff(l_first), 1)
    chars = np.maximum(np.diff(offsets), 1)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])[first]
    columns = [
        np.log1p(n),
        np.diff(lengths) / words,
        np.log1p(words / lines),
        _repeats(hashes, first) / words,
        _repeats(five[whole], windows) / words,
        _repeats(kernels.run_hashes(data, l_starts, l_ends), l_first) / lines,
        np.log1p(lines),
        (n == 0).astype(float),
        *(np.log1p(100 * _per_row(m[data], offsets) / chars) for m in _COUNTED),
    ]
    return np.stack(columns, axis=1)


@dataclass
class QualityModel:
    """Scaling of the statistics, the Fourier features, ridge weights and the calibration's steps."""

    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(x @ self.freq + self.phase) * (2 / FOURIER) ** 0.5, x, np.ones((len(x), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.steps), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the blocks of the best non-decreasing fit of y on x."""
    order = np.lexsort((y, x))
    blocks: list[list[float]] = []  # sum of y, sum of x, size
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, a, 1.0])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


def _numbers(rows: DataFrame, carried: tuple[str, ...], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text")):
                s = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in carried), pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))], [*carried, "s"])

    return rows.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, ridge: float = 1e-2, width: float = 3.0, seed: int = 3) -> QualityModel:
    """Fits on a bounded sample of labelled training rows; a fifth of it calibrates.

    Each task sums its rows' part of the normal equations; the driver adds ``PARTS`` matrices and solves.
    Without labels the score is 0.5; with one class only, that class.
    """
    ws = Workspace(docs.sparkSession, "quality")
    sample = labelled_sample(docs, labels, "quality", max_labelled).select("doc_id", "y", "text")
    stats = ws.table(_numbers(sample, ("doc_id", "y"), "doc_id long, y int, s array<double>"))
    moments = stats.select(*(F.col("s")[i].alias(f"s{i}") for i in range(N_STATISTICS)), "y").agg(F.count("*").alias("n"), F.sum("y").alias("good"), *(f(F.col(f"s{i}")).alias(f"{k}{i}") for i in range(N_STATISTICS) for k, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] or 0.0 for i in range(N_STATISTICS)])
    scale = np.array([moments[f"d{i}"] or 1.0 for i in range(N_STATISTICS)])
    model = QualityModel(mean, scale, rng.normal(0, 1 / width, (N_STATISTICS, FOURIER)), rng.uniform(0, 2 * np.pi, FOURIER), np.zeros(FOURIER + N_STATISTICS + 1), (np.zeros(1), np.full(1, 0.5)))
    if not moments["n"] or moments["good"] in (0, moments["n"]):
        if moments["n"]:
            model.steps = (np.zeros(1), np.full(1, float(moments["good"] > 0)))
        ws.drop(stats)
        return model
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
    size = len(model.weights)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            s = np.array(batch.column("s").to_pylist(), float).reshape(-1, N_STATISTICS)
            z = model.features(s)
            total += z.T @ np.column_stack([z, batch.column("y").to_numpy().astype(float)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    parts = stats.filter(~calibrates).select("s", "y").repartition(PARTS).mapInArrow(equations, "sums binary").collect()
    total = sum(np.frombuffer(r.sums).reshape(size, size + 1) for r in parts)
    penalty = np.full(size, ridge * max(1.0, total[-1, size - 1] / 1000))
    penalty[-1] = 1e-9
    model.weights = np.linalg.solve(total[:, :size] + np.diag(penalty), total[:, size])
    kept = stats.filter(calibrates).select("s", "y").toArrow()
    if kept.num_rows:
        s = np.array(kept.column("s").to_pylist(), float).reshape(-1, N_STATISTICS)
        model.steps = isotonic(model.raw(s), kept.column("y").to_numpy().astype(float))
    else:
        model.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    ws.drop(stats)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.7) for each document's whole text.

    Null and empty texts are scored as texts without words. Repeated rows each give a row. Columns other than
    doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text")):
                s = model.score(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(s), pa.array((s >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
