"""Answer metrics that need an alignment, as Arrow functions over pairs of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions.text import metric_form


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by a bit a word of ``a``: a step of ``b`` is a sum of whole numbers."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, precision, recall, f1) of word subsequences of rows (keys, reference, answer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r, h in zip(batch.column("r").to_pylist(), batch.column("h").to_pylist()):
                a, b = (r or "").split(), (h or "").split()
                n = common_length(a, b)
                p, q = (n / len(b) if b else 0.0), (n / len(a) if a else 0.0)
                out.append((round(p, 4), round(q, 4), round(2 * p * q / (p + q), 4) if n else 0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([o[k] for o in out], pa.float64()) for k in range(3))], [*keys, "precision", "recall", "f1"])

    rows = pairs.select(*(F.col(k).cast("long").alias(k) for k in keys), metric_form(F.col("reference")).alias("r"), metric_form(F.col("answer")).alias("h"))
    return rows.mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "precision double, recall double, f1 double"]))


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of characters."""
    return pd.Series([round(SequenceMatcher(None, (x or "").lower(), (y or "").lower()).ratio(), 4) for x, y in zip(a, b)])


def pseudonym(name: Column, salt: str) -> Column:
    """A keyed hash (HMAC-SHA256) of a name: ``u_`` and 16 hex digits; two plain hashes over the padded key."""
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(x ^ 0x36 for x in key)), name.cast("string").cast("binary")), 256)
    outer = F.sha2(F.concat(F.lit(bytearray(x ^ 0x5C for x in key)), F.unhex(inner)), 256)
    return F.concat(F.lit("u_"), F.substring(outer, 1, 16))


def composite(judge: Column, rouge: Column, keywords: Column, similar: Column, no_answer: Column, length: Column) -> Column:
    """Weighted score of 0 to 10 of an answer; the judge's mark is capped where the other measures contradict it."""
    judge = F.when((rouge < 0.05) & (keywords == 0) & (judge > 4), 4.0).otherwise(judge)
    judge = F.when(no_answer & (judge > 3), 3.0).otherwise(judge)
    judge = F.when((length < 0.15) & (keywords < 0.2) & (judge > 5), 5.0).otherwise(judge)
    return F.round(0.5 * judge + 2 * rouge + 2 * keywords + similar, 4)
