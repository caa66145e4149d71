"""Operators 11 to 13 against plain loops, with nulls, odd numbers, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import hard_negatives, topk_search, vector_codes, vectors

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASH = ("id", "row", "vec", "slot", "score", "rank", "raw", "code", "error", "slice", "norm2", "asks", "anchor", "floor", "of", "label_error", "part")
ODD = [(900, None, 1), (901, [None] * 8, 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (904, [1.0] * 7, 3), (905, [], 3), (None, [0.5] * 8, 4), (None, [0.25] * 8, None), (906, [1e30] + [0.0] * 7, 5), (907, [0.0] * 8, None), (908, [0.0] * 8, 1)]


def some_rows(n=260, length=8, seed=1, spread=1.0):
    r = random.Random(seed)
    out = [(i * 5, [r.uniform(-1, 1) * spread ** r.random() for _ in range(length)], r.randrange(4)) for i in range(n)]
    return out + out[:7] + [(i + 10_000, out[3][1], 2) for i in range(0, 300, 50)]  # repeated rows, and equal vectors under other ids


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


def usable(rows, scale, bits):
    most = min((1 << 31) - 1, int((((1 << bits) - 1) / 8) ** 0.5))
    kept = [(i, np.float32(v), y) for i, v, y in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, [max(-most, min(most, math.floor(float(x) * scale))) for x in v], y) for i, v, y in kept]


def ordered(i):
    return (i is None, i or 0)


def plain_codes(rows, entries=256, rounds=4):
    kept = usable(rows, 1024, 60)
    cut = lambda v, p: v[2 * p : 2 * p + 2]
    first = sorted(kept, key=lambda r: (ordered(r[0]), r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(4)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(4):
            got = defaultdict(list)
            for _, v, _ in kept:
                got[near(cut(v, p), books[p])[0]].append(cut(v, p))
            for e, xs in got.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out = []
    for i, v, y in kept:
        ends = [near(cut(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for e, _ in ends), sum(d for _, d in ends), y))
    by = defaultdict(int)
    for _, _, d, y in out:
        by[y] += d
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, c, d, by[y], sha) for i, c, d, y in out], key=str)


@pytest.mark.parametrize("rows", [some_rows() + ODD, some_rows(40) + ODD, some_rows(300)], ids=["odd", "few", "plain"])
def test_codes_equal_plain_loops(spark, rows):
    out = vector_codes.compress(table(spark, rows).repartition(3))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_codes(rows)


def test_codes_decode_to_their_error(spark):
    rows, length = vector_codes.prepare(table(spark, some_rows()), "vec_id", "embedding", "label", 1024)
    books = vector_codes.fit(rows, length, entries=16)
    coded = vector_codes.decode(vector_codes.encode(rows, books), books)
    was = {r.vec_id: r.vec for r in rows.collect()}
    for r in coded.collect():
        assert sum((a - b) ** 2 for a, b in zip(was[r.vec_id], r.approx)) == r.error


def test_codes_of_uneven_parts_are_refused(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 6, 1)], SCHEMA))


def plain_negatives(rows, anchors, positives=5, negatives=5):
    kept = [(i, v, y) for i, v, y in usable(rows, 256, 53) if y is not None]
    kept = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in kept]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, v, y) in enumerate(kept):
        if i is None or i % anchors:
            continue
        scored = [(-dot(v, w), ordered(j), z, j) for m, (j, w, z) in enumerate(kept) if m != n]
        for s, _, _, p in sorted((x for x in scored if x[2] == y), key=lambda x: x[:2])[:positives]:
            near = sorted((x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s), key=lambda x: x[:2])[:negatives]
            out += [(i, p, k + 1, x[3], -s, -x[0]) for k, x in enumerate(near)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8192, 7])
@pytest.mark.parametrize("rows", [some_rows() + ODD, some_rows(300)], ids=["odd", "plain"])
def test_negatives_equal_plain_loops(spark, rows, block, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES", 5)
    out = hard_negatives.mine(table(spark, rows).repartition(3), hard_negatives.relabelled(), F.col("vec_id") % 20 == 0, block=block)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got and got == plain_negatives(rows, 20)


def plain_search(rows, every, k=5):
    kept = usable(rows, 256, 53)
    out = []
    for n, (i, v, _) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), ordered(j), j) for m, (j, w, _) in enumerate(kept) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,slice_rows,bucket", [(8192, 65_536, 2048), (9, 40, 16)])
@pytest.mark.parametrize("spread", [1.0, 0.001])
def test_search_equals_plain_loops(spark, monkeypatch, block, slice_rows, bucket, spread):
    rows = some_rows(spread=spread) + ODD
    monkeypatch.setattr(topk_search, "LONGEST", bucket)
    out = topk_search.top_products(table(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, block=block, slice_rows=slice_rows)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == plain_search(rows, 10)


def prunes(base, queries, k=5, size=64):
    """The search over buckets of ``size`` longest-first vectors, without Spark: (best, queries that left a bucket out, by coordinates, by length)."""
    length = np.sqrt((base * base).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    q_len = np.sqrt((queries * queries).sum(axis=1))
    unit = queries / np.maximum(q_len, 1)[:, None]
    asked = (np.full(len(queries), -1), q_len, queries, unit, np.argsort(-np.abs(unit), axis=1, kind="stable")[:, : topk_search.FOCUS])
    best, counts = vectors.Best(len(queries), k), np.zeros(3, int)
    for lo in range(0, len(base), size):
        some = order[lo : lo + size]
        counts += topk_search.search_bucket(best, asked, np.full(len(queries), -np.inf), (some, some.astype(np.int64), length[some], base[some]))
    return best, counts


@pytest.mark.parametrize("kind", ["clusters", "lengths", "zeros", "equal"])
def test_buckets_prune_and_lose_nothing(kind):
    r = np.random.default_rng(3)
    centers = r.normal(size=(20, 16)) * 300
    base = np.floor(centers[r.integers(0, 20, 3000)] + r.normal(size=(3000, 16)) * (30 if kind == "clusters" else 200))
    if kind == "lengths":
        base = np.floor(base * r.pareto(1.5, 3000)[:, None])
    if kind == "zeros":
        base[::3] = 0
    if kind == "equal":
        base[:1500] = base[0]
    queries = np.vstack([base[::97], np.zeros((1, 16)), -base[:1]])
    best, (left_out, by_coordinates, by_length) = prunes(base, queries)
    ids = np.arange(3000)
    for s, q in enumerate(queries):
        scores = base @ q
        order = np.lexsort((ids, -scores))[:5]
        assert best.ids[s].tolist() == order.tolist() and best.scores[s].tolist() == scores[order].tolist()
    assert by_length and (kind != "clusters" or by_coordinates) and (kind != "lengths" or left_out)


def test_best_keeps_the_first_of_equal_scores():
    r = np.random.default_rng(5)
    best, seen = vectors.Best(3, 4), [[] for _ in range(3)]
    for _ in range(30):
        ids = np.sort(r.choice(10_000, 9, replace=False)).astype(np.int64)
        scores = r.integers(0, 4, (3, 9)).astype(float)
        scores[r.random((3, 9)) < 0.3] = -np.inf
        slots = np.flatnonzero(r.random(3) < 0.8)
        best.offer(slots, scores[slots], ids)
        for s in slots:
            seen[s] += [(-x, i) for x, i in zip(scores[s], ids) if x > -np.inf]
    for s in range(3):
        assert [(-x, i) for x, i in zip(best.scores[s], best.ids[s])] == sorted(seen[s])[:4]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        df = table(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
        assert vector_codes.compress(df).collect() == []
        assert hard_negatives.mine(df, hard_negatives.relabelled(), F.col("vec_id") % 100 == 0).collect() == []
        assert topk_search.top_products(df, F.col("vec_id") % 50 == 0).collect() == []
