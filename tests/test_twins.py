"""PageRank to convergence, baskets in blocks, decomposed folding against plain loops."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import fold_marks
from quillspark.operators import graphs as G
from quillspark.operators import recommend as C
from quillspark.plans import catalogue
from quillspark.sources.tables import table


def test_pagerank_equals_power_iteration(spark, sf):
    got = {r.node: r["rank"] for r in catalogue.queries()["gr5_ppr_whole"](spark, sf).collect()}
    weight = defaultdict(float)
    for o in table(spark, sf, "orders").collect():
        weight[f"c{o.o_custkey}", f"o{o.o_orderkey}"] = 1.0
    for x in table(spark, sf, "lineitem").collect():
        weight[f"o{x.l_orderkey}", f"p{x.l_partkey}"] = max(weight[f"o{x.l_orderkey}", f"p{x.l_partkey}"], x.l_quantity)
    names = sorted({n for pair in weight for n in pair})
    at = {n: i for i, n in enumerate(names)}
    src, dst, w = (np.array(c) for c in zip(*((at[a], at[b], v) for (a, b), v in weight.items())))
    total = np.bincount(src, w, len(names))
    seeds = np.array([float(n[0] == "c" and int(n[1:]) % 20 == 0) for n in names])
    seeds /= seeds.sum()
    rank = seeds
    for _ in range(50):
        spread = np.bincount(dst, rank[src] * w / total[src], len(names))
        new = 0.15 * seeds + 0.85 * (spread + rank[total == 0].sum() * seeds)
        done = np.abs(new - rank).sum() < 1e-5
        rank = new
        if done:
            break
    want = {n: r for n, r in zip(names, rank) if round(r, 9) > 0}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=2e-9) for n in want)


@pytest.mark.parametrize("block", [1024, 3])
def test_baskets_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3]), r.randrange(25), r.choice([0.1, 1.0, 2.0])) for _ in range(120)]
    weights = defaultdict(float)
    for k, i, w in rows:
        weights[k, i] = max(weights[k, i], w)
    want = defaultdict(float)
    for (k, a), u in weights.items():
        for (j, b), v in weights.items():
            if k == j and a < b:
                want[a, b] += u * v
    got = {(x.a, x.b): x.both for x in C.co_visits(spark.createDataFrame(rows, "k int, i int, w double"), "k", "i", "w").collect()}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_fold_marks(spark):
    texts = ["Điện ấy ở đâu", "plain", None, "", "á̧ ê ñ", "ิ stays, ͠ goes", "ﬁ Å"]
    got = [x.t for x in fold_marks(spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("t", F.lower("t")), "t").sort("i").collect()]
    assert got == [None if t is None else "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not 0x300 <= ord(c) < 0x370).replace("đ", "d") for t in texts]


@pytest.mark.parametrize("hops", [2, 6])
def test_relation_paths_equal_a_search(spark, hops):
    r = random.Random(3)
    edges = {(f"n{r.randrange(14)}", r.choice(["a", "b"]), f"n{r.randrange(14)}") for _ in range(22)}
    asked = [(q, t, r.choice([f"n{r.randrange(14)}", "missing"]), f"n{q % 14}") for q in range(30) for t in range(2)]
    out = G.relation_paths(spark.createDataFrame(sorted(edges), "src string, relation string, dst string"), spark.createDataFrame(asked, "qid int, turn int, seed string, target string"), hops)
    got = {x.qid: (x.seed, x.hops, x.path) for x in out.collect()}

    def search(seed, target):
        ways = {seed: [seed]}
        for _ in range(hops):
            new = {}
            for node in ways:
                for s, _, d in edges:
                    if s == node and d not in ways:
                        new[d] = min(new.get(d, [*ways[node], d]), [*ways[node], d])
            # only ways that grew in the last round may grow on, which dictionary order of earlier ones doesn't change
            ways |= new
        return ways.get(target)

    want = {}
    for q, t, seed, target in asked:
        if q not in want and (way := search(seed, target)):
            told = [f"{a} --[{min(rel for s, rel, d in edges if (s, d) == (a, b))}]-->" for a, b in zip(way, way[1:])]
            want[q] = (seed, len(way) - 1, " ".join([*told, target]))
    assert got == want and len(want) >= 7
