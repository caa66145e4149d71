"""Operators against plain loops on small tables."""

import hashlib
import hmac
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import strip_marks, token_count, tokens
from quillspark.operators import fusion, graphs, retrieval
from quillspark.operators.chunking import hard_split
from quillspark.operators.evaluation import pseudonym


@pytest.mark.parametrize("cell", [(1024, 65_536), (3, 7)])
def test_dense_cells(spark, monkeypatch, cell):
    monkeypatch.setattr(retrieval, "CELL_QUERIES", cell[0])
    monkeypatch.setattr(retrieval, "CELL_VECTORS", cell[1])
    rng = np.random.default_rng(2)
    v = rng.integers(-2, 3, (60, 4)).astype(np.float32)  # many equal scores
    emb = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.dense(emb, emb.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id"), 4).collect()}
    dots = v @ v.T
    want = {(q, k + 1): (i, float(dots[q, i])) for q in range(0, 60, 5) for k, i in enumerate(sorted(range(60), key=lambda i: (-dots[q, i], i))[:4])}
    assert got == want
    assert retrieval.dense(emb, emb.limit(0).withColumnRenamed("vec_id", "query_id"), 4).count() == 0


def test_token_count_is_the_number_of_tokens(spark):
    rows = spark.createDataFrame([("a bc 1 22 _ __ é éé x1 1x ¼ a1b2",), ("",), (None,), ("7,8;9 ٣ ab",)], "t string")
    assert all(r.a == r.b for r in rows.select(token_count(F.col("t")).alias("a"), F.size(tokens(F.col("t"))).alias("b")).collect())


def test_hard_split():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n" if rng.random() < 0.3 else "abcdefgh") for _ in range(rng.randrange(0, 120))).strip()
        most, rest, want = 20, text, []
        while len(rest) > most:
            cut = next((c for c in range(most, most // 2, -1) if rest[c] in " \n"), most // 2)
            want.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        want.append(rest)
        assert hard_split(text, most) == [x for x in want if x]
        assert all(len(x) <= most for x in hard_split(text, most))


def test_pseudonym_is_hmac(spark):
    for salt in ("salt", "k" * 100):
        rows = spark.createDataFrame([("Customer#1",), ("é",), ("",)], "n string").select("n", pseudonym(F.col("n"), salt).alias("p")).collect()
        assert all(r.p == "u_" + hmac.new(salt.encode(), r.n.encode(), hashlib.sha256).hexdigest()[:16] for r in rows)


def test_pagerank_converges(spark):
    rng = random.Random(3)
    edges = [(a, b, 1.0 + (a * b) % 3) for a in range(12) for b in rng.sample(range(14), 3) if a != b]
    got = {r.node: r["rank"] for r in graphs.personal_pagerank(spark.createDataFrame(edges, "src int, dst int, weight double"), spark.createDataFrame([(0,), (5,)], "node int")).collect()}
    nodes = sorted({x for e in edges for x in e[:2]} | {0, 5})
    total = {a: sum(w for s, _, w in edges if s == a) for a in nodes}
    start = {n: 0.5 if n in (0, 5) else 0.0 for n in nodes}
    rank = dict(start)
    for _ in range(200):
        lost = sum(rank[n] for n in nodes if not total[n])
        rank = {n: 0.15 * start[n] + 0.85 * (sum(rank[s] * w / total[s] for s, d, w in edges if d == n) + lost * start[n]) for n in nodes}
    assert got.keys() == rank.keys() and max(abs(got[n] - rank[n]) for n in nodes) < 1e-4


def test_routes_by_plain_relaxation(spark):
    rng = random.Random(4)
    edges = [(a, b, float(rng.randrange(1, 6)), "closed" if rng.random() < 0.1 else "open") for a in range(15) for b in rng.sample(range(15), 3) if a != b]
    df = spark.createDataFrame(edges, "src int, dst int, weight double, status string")
    got = {r.node: (r.cost, r.path) for r in graphs.shortest_routes(df, spark.createDataFrame([(0,)], "node int")).collect()}
    best = {0: (0.0, [0])}
    for _ in range(20):
        for a, b, w, s in edges:
            if s == "open" and a in best and (offer := (best[a][0] + w, [*best[a][1], b])) < best.get(b, (1e9, [])):
                best[b] = offer
    assert got == best
    assert graphs.multi_stop(df, [0, 99]).count() == 0


def test_alpha_of_a_zero_model_and_of_other_dimensions(spark):
    emb = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "vec_id long, embedding array<double>")
    assert [round(r.alpha, 9) for r in fusion.predicted_alpha(emb, np.zeros((fusion.BINS, 2)), np.zeros(fusion.BINS)).collect()] == [0.5] * 3
    steep = np.zeros((fusion.BINS, 2))
    steep[90:] = 50.0
    got = {r.vec_id: r.alpha for r in fusion.predicted_alpha(emb, steep, np.zeros(fusion.BINS)).collect()}
    assert got[1] > 0.9 and got[2] == got[3] == 0.5


def test_diverse_selection_by_plain_loop(spark):
    rng = random.Random(5)
    pools = {q: [(i, rng.randrange(10) / 2, rng.sample("abcdefgh", 4)) for i in range(q + 3)] for q in range(6)}
    rows = [(q, i, s, w) for q, pool in pools.items() for i, s, w in pool]
    got = {(r.q, r.place): r["item"] for r in retrieval.select_diverse(spark.createDataFrame(rows, "q long, item long, score double, words array<string>"), "q", 5).collect()}
    for q, pool in pools.items():
        left = sorted(pool, key=lambda p: (-p[1], p[0]))
        if len(left) <= 5:
            chosen = left
        else:
            chosen = []
            while len(chosen) < 5:
                near = lambda p: max((len(set(p[2]) & set(c[2])) / len(set(p[2]) | set(c[2])) for c in chosen), default=0.0)  # noqa: E731, B023
                best = max(left, key=lambda p: 0.7 * p[1] - 0.3 * near(p))
                left.remove(best)
                chosen.append(best)
        assert [got[q, k + 1] for k in range(len(chosen))] == [p[0] for p in chosen]


def test_strip_marks(spark):
    texts = ["Điều é ñ ü ấ", "plain", None, "é"]
    rows = strip_marks(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), "text").collect()
    bare = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    assert [r.text for r in rows] == [bare(t) for t in texts]


def test_candidates_keep_the_earliest_best_source(spark):
    one = spark.createDataFrame([(1, 10, 5.0), (1, 11, 7.0)], "u long, item long, raw double")
    two = spark.createDataFrame([(1, 10, 5.0), (1, 11, 8.0), (2, 10, 1.0)], "u long, item long, raw double")
    got = {(r.u, r["item"]): (r.raw, r.source) for r in fusion.best_source([("one", one), ("two", two)], "u").collect()}
    assert got == {(1, 10): (5.0, "one"), (1, 11): (8.0, "two"), (2, 10): (1.0, "two")}
