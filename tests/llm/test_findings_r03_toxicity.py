"""What the third round's findings named of op5: all labelled rows are learned from, in shards of bounded size."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import folds, toxicity
from quillspark.llm.folds import held_out


def test_f7_every_labelled_row_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(20)) + (" vile" if i % 3 == 0 else ""), "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    seen, start = [], toxicity.ConvNet.start
    monkeypatch.setattr(toxicity.ConvNet, "start", lambda net, present, n: seen.append(n.copy()) or start(net, present, n))
    net, cuts = toxicity.fit(docs, labels)
    hold = F.pmod(F.xxhash64(F.lit("hold"), "doc_id"), F.lit(5)) == 4
    want = labels.filter(~held_out() & ~hold).groupBy("toxic").count().orderBy("toxic").collect()
    assert list(seen[0]) == [x["count"] for x in want] and sum(seen[0]) > 3 * 150 and set(cuts) == {"en"}
    again, _ = toxicity.fit(docs.repartition(3), labels)
    assert (net.packed() == again.packed()).all() and net.offset == again.offset
    got = [x for x in toxicity.score(docs, net, cuts).collect() if x.held_out]
    assert all(x.predicted == (x.doc_id % 3 == 0) for x in got)


def test_f7_thresholds_by_counts():
    assert toxicity.best_cut(*map(np.array, ([0.1, 0.9, 0.5], [10, 2, 3], [0, 2, 3]))) == 0.3


def test_op5_only_labelled_rows_are_shuffled(spark):
    """Rows without a label go before the shuffle; all labelled ones stay, and the join is the same at every size."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id")).alias("text"), F.lit("en").alias("lang")).union(spark.createDataFrame([(20, None, None), (None, "x", "en")], "doc_id long, text string, lang string"))
    labels = spark.range(0, 6000, 20).select(F.col("id").alias("doc_id"), (F.col("id") % 40 == 0).cast("int").alias("toxic"))
    train = {i for i in range(0, 3000, 20) if zlib.crc32(str(i).encode()) % 4 != 2}
    rows = toxicity.learning_rows(docs, labels)
    got = rows.select("doc_id", "y", F.size("words").alias("n")).collect()
    want = [(i, int(i % 40 == 0), 4) for i in train] + ([(20, 0, 0)] if 20 in train else [])
    assert sorted(map(tuple, got)) == sorted(want)
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
    bits = folds.id_filter(folds.labels_to_learn(labels, "toxic"))
    at = docs.select("doc_id", *(b.alias(f"b{i}") for i, b in enumerate(folds.id_bits(64 * len(bits))))).filter("doc_id IS NOT NULL").toPandas()
    held = {d for d, a, b in at.itertuples(index=False) if bits[a >> 6] >> (a & 63) & bits[b >> 6] >> (b & 63) & 1}
    assert train <= held and len(held) < len(train) + 60
