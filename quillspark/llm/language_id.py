"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import held_out

ORDERS, BITS = (1, 2, 3), 16
#: Documents that the model is fitted on, about, chosen by hash; of each language so many at least, if it has them.
MAX_TRAIN, LEAST_TRAIN = 20_000, 500
CHUNK_CHARS = 1 << 19


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, code points, start of each row): lower-cased, each row closed by a zero."""
    lo = 0
    while lo < len(texts):
        hi, total, rows = lo, 0, []
        while hi < len(texts) and (hi == lo or total < CHUNK_CHARS):
            rows.append((texts[hi] or "").lower())
            total += len(rows[-1]) + 1
            hi += 1
        points = np.frombuffer(("\0".join(rows) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in rows], out=at[1:])
        yield lo, hi, points, at
        lo = hi


def _buckets(points: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket of the n-gram at each place, and which places hold a whole n-gram of one row."""
    key = np.zeros(len(points), np.uint64)
    for k in range(order):
        key[: len(points) - k] += points[k:].astype(np.uint64) * np.uint64(pow(0x9E3779B97F4A7C15, 4 * order + k, 1 << 64))
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    whole = np.ones(len(points), bool)
    for k in range(order):
        last = at[1:] - 1 - k
        whole[last[last >= at[:-1]]] = False
    return (key >> np.uint64(64 - BITS)).astype(np.int64), whole


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class LanguageModel:
    """langs, and a matrix of log-probabilities: a row for each n-gram bucket, a column for each language."""

    def __init__(self, langs: list[str], prior: np.ndarray, counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        self.prior = np.log(prior / prior.sum()) if len(langs) else prior
        smooth = counts + alpha  # (orders, buckets, languages)
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    def log_scores(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.repeat(self.prior[None, :], len(at) - 1, axis=0).astype(np.float64)
        for k, order in enumerate(ORDERS):
            bucket, whole = _buckets(points, at, order)
            values = self.table[k][bucket]
            values[~whole] = 0
            out += np.add.reduceat(values, at[:-1], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Counts n-grams in the tasks; the driver gets a row for each language and bucket seen.

    A language's prior is its share of all training rows; its n-grams come from its part of the sample.
    """
    rows = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(~held_out() & F.col("lang").isNotNull())
    share = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    n = sum(share.values())
    part_of = F.lit(min(1.0, max_train / max(n, 1)))
    for x, k in sorted(share.items()):
        if k * min(1.0, max_train / n) < LEAST_TRAIN:
            part_of = F.when(F.col("lang") == x, F.lit(min(1.0, LEAST_TRAIN / k))).otherwise(part_of)
    part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.ceil(1_000_000 * part_of)).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, points, at in _slices(batch.column("text").to_pylist()):
                names, code = np.unique(np.array(langs[lo:hi], dtype=object).astype(str), return_inverse=True)
                who = np.repeat(code, np.diff(at))
                for x in names.tolist():
                    counts.setdefault(x, np.zeros((len(ORDERS), 1 << BITS), np.int64))
                for k, order in enumerate(ORDERS):
                    bucket, whole = _buckets(points, at, order)
                    for j, x in enumerate(names.tolist()):
                        counts[x][k] += np.bincount(bucket[whole & (who == j)], minlength=1 << BITS)
        for x, table in counts.items():
            flat = table.ravel()
            full = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(flat[full])], ["lang", "bucket", "n"])

    got = part.select("text", "lang").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(share, key=lambda s: s.encode())
    number = {x: i for i, x in enumerate(names)}
    code = np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)
    counts = np.zeros((len(ORDERS) << BITS, len(names)))
    counts[got.column("bucket").to_numpy(), code] = got.column("n").to_numpy().astype(np.float64)
    return LanguageModel(names, np.array([share[x] for x in names], float), counts.reshape(len(ORDERS), 1 << BITS, len(names)))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the posterior of lang_pred) for each document's whole text.

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
    learned. Repeated rows each give a row; ties go to the first language by code point. Columns other than
    doc_id and text are not read.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if model.langs:
                for lo, hi, points, at in _slices(texts):
                    logs = model.log_scores(points, at)
                    best[lo:hi] = logs.argmax(axis=1)
                    score[lo:hi] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            known = [bool(model.langs) and has_letter(t) for t in texts]
            names = [model.langs[b] if k else "und" for b, k in zip(best.tolist(), known)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
