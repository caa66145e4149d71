"""Training folds and bounded samples for the learned operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out():
    """Rows never learned from: crc32 of the doc_id as text, modulo 4, is 2. A null doc_id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def labels_to_learn(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of all labelled training rows."""
    pick = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    return pick.filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).distinct()


def id_bits(size: int) -> list:
    """The two bits that stand for a doc_id in a filter of so many."""
    return [F.pmod(F.xxhash64(F.lit(i), "doc_id"), F.lit(size)) for i in (0, 1)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of doc_ids in words of 64 bits, 16 to 32 bits an id: it holds every id and about one other in a hundred."""
    size = 1 << max(16, (16 * ids.count()).bit_length())
    bit = ids.select(F.explode(F.array(*id_bits(size))).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("word")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, lang, y) of ``most`` labelled training rows at most, the first by hash of doc_id."""
    pick = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    pick = pick.distinct().withColumn("k", F.xxhash64("doc_id")).orderBy("k", "doc_id", "y").limit(most).drop("k")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.cast("string").alias("lang")).join(F.broadcast(pick), "doc_id")
