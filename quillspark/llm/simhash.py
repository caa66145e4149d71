"""SimHash near-duplicates by pigeonhole blocks (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .components import connected
from .ids import keyed, loose, solid
from .workspace import Workspace

#: 64 bits in four blocks of 16. Two differing bits touch two blocks at most, so two others agree.
BLOCK_BITS, BLOCKS = 16, 4
#: A block group of more fingerprints is split by the same principle on the bits its members don't share.
HOT = 64


def shingle_spans(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased texts with single spaces between words, the spans of their shingles, and each document's first shingle."""
    data = kernels.LOWER[data]
    starts, ends, first = kernels.runs(data, offsets, kernels.NOT_SPACE)
    n_words = np.diff(first)
    keep = kernels.NOT_SPACE[data]
    keep[ends[ends < len(data)]] = True  # the first byte after a word is a separator or another document's
    data = np.where(kernels.NOT_SPACE[data], data, 32).astype(np.uint8)
    place = np.cumsum(keep) - 1
    lengths = ends - starts
    starts = place[starts] if len(starts) else starts
    ends = starts + lengths
    n = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    head = np.repeat(first[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    tail = np.minimum(head + width, np.repeat(first[1:], n)) - 1
    return data[keep].tobytes(), starts[head], ends[tail], at


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint of each document: a bit is 1 if set in over half of its hashes."""
    out = np.zeros(len(first) - 1, np.uint64)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first[full], axis=0, dtype=np.int32)
        ones = 2 * counts > np.diff(first)[full][:, None]
        out[full] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, a null doc_id as the largest; with ``keys``, string columns, between."""
    names = ["doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text")):
                joined, a, b, first = shingle_spans(data, offsets, width)
                hashes = np.fromiter((digest(joined[x:y], seed) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in names), pa.array(majority(hashes, first).view(np.int64))], [*names, "fp"])

    return docs.select(solid(), *keys, F.col("text").cast("string")).mapInArrow(run, ", ".join(["doc_id long", *(f"{c} string" for c in keys), "fp long"]))


def _bits(fp, lo: int, n: int):
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _pair_keys(fp, lo: int, block: int):
    """Keys of a fingerprint in the six tables over four blocks of so many bits from lo on."""
    parts = [_bits(fp, lo + i * block, block) for i in range(BLOCKS)]
    return [F.shiftleft(F.lit(t).cast("long"), 2 * block).bitwiseOR(F.shiftleft(parts[i], block)).bitwiseOR(parts[j]) for t, (i, j) in enumerate(combinations(range(BLOCKS), 2))]


def near_pairs(fps: DataFrame, ws: Workspace) -> DataFrame:
    """Links (a < b) between distinct fingerprints at two or fewer differing bits; ``fps`` has one column fp.

    Members of a block group share 32 bits. In a small group each pair is verified. A hot group is split
    on the 32 bits that its members need not share: four sub-blocks of 8, two of which agree again. What
    is still hot after that shares 48 bits, and its members are joined on what is left with one or two
    bits masked: 137 keys a member, each shared by four members at most, so no group's pairs are all made.
    """
    def by_size(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
        marked = rows.join(sizes, keys)
        return marked.filter(F.col("n") <= HOT).drop("n"), marked.filter(F.col("n") > HOT).drop("n")

    def pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
        a, b = rows.withColumnRenamed("fp", "a"), rows.withColumnRenamed("fp", "b")
        return a.join(b, keys).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")

    def by_table(table, make):
        """make(blocks of the key, other blocks) for the table at hand."""
        out = F.lit(None).cast("long")
        for t, pair in enumerate(combinations(range(BLOCKS), 2)):
            out = F.when(table == t, make(pair, tuple(x for x in range(BLOCKS) if x not in pair))).otherwise(out)
        return out

    keyed = fps.select("fp", F.explode(F.array(*_pair_keys(F.col("fp"), 0, BLOCK_BITS))).alias("key"))
    small, hot = by_size(keyed, ["key"])
    links = [pairs(small, ["key"])]
    hot = ws.table(hot)
    if not hot.isEmpty():
        # The bits outside the two blocks of the key, packed to the low 32.
        fp = F.col("fp")
        rest = by_table(F.shiftrightunsigned("key", 2 * BLOCK_BITS), lambda _, free: F.shiftleft(_bits(fp, free[1] * BLOCK_BITS, BLOCK_BITS), BLOCK_BITS).bitwiseOR(_bits(fp, free[0] * BLOCK_BITS, BLOCK_BITS)))
        sub = hot.withColumn("rest", rest)
        sub = sub.select("fp", "key", "rest", F.explode(F.array(*_pair_keys(F.col("rest"), 0, 8))).alias("sub"))
        small, dense = by_size(sub, ["key", "sub"])
        links.append(pairs(small.drop("rest"), ["key", "sub"]))
        masks = [0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i, j in combinations(range(32), 2))]
        free_bits = by_table(F.shiftrightunsigned("sub", 16), lambda _, free: F.lit(sum(0xFF << (8 * i) for i in free)).cast("long"))
        mask = F.explode(F.filter(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseAND(F.col("free_bits")) == m)).alias("mask")
        masked = dense.withColumn("free_bits", free_bits).select("fp", "key", "sub", "rest", mask)
        masked = masked.select("fp", "key", "sub", "mask", F.col("rest").bitwiseAND(F.bitwise_not("mask")).alias("core"))
        links.append(pairs(masked, ["key", "sub", "mask", "core"]))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct()


def groups_of(prints: DataFrame, ws: Workspace) -> DataFrame:
    """(fp, group): the smallest linked fingerprint, for each distinct fingerprint of ``prints``."""
    fps = ws.table(prints.select("fp").distinct())
    links = ws.table(near_pairs(fps, ws))
    labels = connected(links.toDF("u", "v"), ws)
    out = ws.table(fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group")))
    ws.drop(fps, links)
    return out


def _joined_ids(prints: DataFrame, groups: DataFrame, ws: Workspace) -> DataFrame:
    """``groups`` after rows that share a doc_id have brought their fingerprints' groups together."""
    spread = prints.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("doc_id")
    spread = ws.table(prints.join(spread, "doc_id", "left_semi").join(groups, "fp").select("doc_id", "group").distinct())
    if spread.isEmpty():
        return groups
    first = spread.groupBy("doc_id").agg(F.min("group").alias("v"))
    up = ws.table(connected(spread.join(first, "doc_id").select(F.col("group").alias("u"), "v"), ws)).toDF("group", "higher")
    return ws.table(groups.join(up, "group", "left").select("fp", F.coalesce("higher", "group").alias("group")))


def near_duplicates(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows and ties
    keep a row each. Rows of one doc_id are one document: what any of them is linked to is reachable from all,
    and they share a component_id. A null doc_id is one id, the largest. Other columns are ignored. An empty
    table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    prints = ws.table(fingerprints(docs, width, seed))
    groups = _joined_ids(prints, groups_of(prints, ws), ws)
    least = ws.table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).join(groups, "fp"))
    smallest = least.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = ws.table(least.select("fp", "group").join(smallest, "group").select("fp", "component_id"))
    ws.drop_all_but(prints, classes)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(classes, "fp").select(loose(), hexed.alias("fingerprint"), loose("component_id"))


def first_rows(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """The row of smallest (doc_id, key) of each group of near copies, whatever ids its rows have.

    Groups are of fingerprints, so rows of one doc_id, null too, are in one group only if their texts are
    linked. A null doc_id is the largest.
    """
    spark: SparkSession = docs.sparkSession
    ws = Workspace(spark, "first")
    rows = keyed(docs, Workspace(spark, "rows"))
    prints = ws.table(fingerprints(rows.select("doc_id", "key", "row.text"), width, seed, ("key",)).groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("at")))
    groups = prints.join(groups_of(prints, ws), "fp").groupBy("group")
    first = ws.table(groups.agg(F.min("at").alias("at")).select("at.doc_id", "at.key"))
    ws.drop_all_but(first)
    # As many keys as groups, so joined by a shuffle at every size.
    return rows.join(first.hint("merge"), ["doc_id", "key"], "left_semi").select("row.*")
