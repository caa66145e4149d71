"""What the third round's findings named, against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import candidates as D
from quillspark.operators import explore as X
from quillspark.operators import graphs as G
from quillspark.operators import knowledge as N
from quillspark.operators import retrieval as R
from quillspark.plans import world_queries as W
from quillspark.streaming import tracking as K


def plain_ranks(edges, seeds, rounds, tolerance):
    nodes = sorted({x for e in edges for x in e[:2]} | set(seeds))
    total = {a: sum(w for s, _, w in edges if s == a) for a in nodes}
    start = {n: 1 / len(seeds) if n in seeds else 0.0 for n in nodes}
    rank = dict(start)
    for _ in range(rounds):
        lost = sum(rank[n] for n in nodes if not total[n])
        new = {n: 0.15 * start[n] + 0.85 * (sum(rank[s] * w / total[s] for s, d, w in edges if d == n) + lost * start[n]) for n in nodes}
        change, rank = sum(abs(new[n] - rank[n]) for n in nodes), new
        if tolerance is not None and change < tolerance:
            break
    return rank


LAYERS = [(a, 10 + b, 1.0 + (a + b) % 3) for a in range(5) for b in range(a, a + 3)] + [(10 + b, 20 + b // 2, 2.0) for b in range(7) if b != 4]
CROSSING = [*LAYERS, (0, 20, 4.0)]
ROUND = [*LAYERS, (20, 0, 1.0)]


@pytest.mark.parametrize("edges,rounds,tolerance", [(LAYERS, 50, 1e-5), (CROSSING, 3, 1e-5), (ROUND, 9, None), (ROUND, 3, None), (LAYERS, 0, None)])
def test_f1_pagerank_equals_its_rounds(spark, edges, rounds, tolerance):
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    got = {r.node: r["rank"] for r in G.personal_pagerank(df, spark.createDataFrame([(0,), (2,), (99,)], "node int"), rounds, tolerance=tolerance).collect()}
    want = plain_ranks(edges, {0, 2, 99}, rounds, tolerance)
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n], abs=1e-12) for n in want)


def test_f1_layers_are_walked_once(spark, monkeypatch):
    written = []
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or cut(df))
    df = spark.createDataFrame(LAYERS, "src int, dst int, weight double")
    G.personal_pagerank(df, spark.createDataFrame([(0,)], "node int")).collect()
    assert len(written) <= 6


def test_f2_f4_a_spot_stands_once(spark):
    """Many places at one spot: a ping meets the spot, not each of them; the first by name is the nearest."""
    r = random.Random(6)
    places = [(f"p{i:03}", 10 + i % 7 * 1e-3, 106.0, r.choice(["building", "gate"])) for i in range(200)]
    pings = [(1, i, 10 + r.randrange(70) * 1e-4, 106.0 if i % 9 else None) for i in range(60)]
    rows = spark.createDataFrame(pings, "user_id long, event_id long, lat double, lon double")
    rows = rows.select("*", F.timestamp_seconds("event_id").alias("ts"), *(F.lit(None).cast("string").alias(c) for c in ("destination", "scheduled", "search")))
    out = K.snapped(rows, spark.createDataFrame(places, "place string, lat double, lon double, kind string"))
    got = {x.event_id: (x.place, x.eligible) for x in out.collect()}
    spots = {k: (places[k][0], places[k][3] == "building") for k in range(7)}
    for _, i, lat, lon in pings:
        want = min((round(abs(lat - 10 - k * 1e-3), 9), spots[k]) for k in spots)[1] if lon else (None, False)
        assert got[i] == want
    assert "min(struct(place" in out._jdf.queryExecution().analyzed().toString()


def test_f3_a_text_is_asked_once(spark, monkeypatch):
    asked = []
    scores = D.tfidf_scores
    monkeypatch.setattr(D, "tfidf_scores", lambda items, q, *a: asked.append(q) or scores(items, q, *a))
    frame = spark.createDataFrame
    found = frame([(1, 7, 0.5, 1)], "user long, item long, score double, rank long")
    interests = frame([(u, "red ring" if u % 2 else "blue bolt") for u in range(1, 21)], "user long, text string")
    items = frame([(1, "red ring"), (2, "blue bolt"), (3, "red bolt"), (4, "old gear")], "item long, text string")
    got = sorted((x.user, x.item, x.source) for x in D.with_cold_start(found, interests, items, "user", "item", 2).collect())
    assert got == sorted([(1, 7, "similar")] + [(u, i, "interests") for u in range(2, 21) for i in ((1, 3) if u % 2 else (2, 3))])
    assert asked[0].count() == 2


def test_retrieval_in_cells_equals_a_plain_loop(spark, monkeypatch):
    """F10 to F17, F19, F20, F23 to F27: cells of a few queries and documents, hot and rare words, ties, shared texts."""
    for name, n in (("SPARSE_QUERIES", 8), ("SPARSE_DOCS", 20), ("SPARSE_STEP", 3), ("DENSE_SHARE", 0.5)):
        monkeypatch.setattr(R, name, n)
    r = random.Random(8)
    text = lambda n: " ".join(r.choice(["the", "of", *(f"w{int(r.random() ** 2 * 30)}" for _ in range(2))]) for _ in range(n))
    docs = [(i, text(r.randrange(1, 12))) for i in range(90)]
    docs += [(1000 + i, t) for i, t in docs[:20]] + [(2000, None), (2001, "")]
    queries = [(i, text(6)) for i in range(20)]
    queries += [(100 + i, t) for i, t in queries[:7]] + [(200, None), (201, "unheard")]
    words = {i: (t or "").split() for i, t in docs}
    df, avg = Counter(w for ws in words.values() for w in set(ws)), sum(map(len, words.values())) / len(words)
    score = lambda q, ws: round(sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in q if w in ws), 6)
    want = {}
    for qid, t in queries:
        hits = sorted((-score((t or "").split(), ws), i) for i, ws in words.items())
        want |= {(qid, n + 1): (i, -s) for n, (s, i) in enumerate(h for h in hits if h[0] < 0) if n < 4}
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    asked = []
    top = R.sparse_top
    monkeypatch.setattr(R, "sparse_top", lambda a, *x: asked.append(a) or top(a, *x))
    for index in (None, R.term_index(d, "doc_id")):
        got = {(x.item_id, x["rank"]): (x.doc_id, x.score) for x in R.bm25(d, q, "doc_id", "item_id", 4, index=index).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in want)
        assert sum(got[k][0] != want[k][0] for k in want) <= 1
    assert asked[0].select("item_id").distinct().count() <= 20


def test_f5_f9_spots_meet_once(spark, monkeypatch):
    """Many points and places at few spots: no more spots meet than there are, and every point has its answer."""
    met = []
    within = X.within
    monkeypatch.setattr(X, "within", lambda points, places, m: met.append((points.count(), places.count())) or within(points, places, m))
    points = spark.createDataFrame([(i, 10.0 + i % 2 * 1e-3, 106.0) for i in range(200)], "pid int, lat double, lon double")
    places = spark.createDataFrame([(i, 10.0 + i % 3 * 1e-3, 106.0, "c" if i % 5 else None) for i in range(300)], "place int, place_lat double, place_lon double, cluster string")
    got = {x.pid: (x.cluster, x.votes, x.near) for x in X.explore_clusters(points, places, "pid", 120.0).collect()}
    assert got == {i: ("c", 160 if i % 2 == 0 else 240, 200 if i % 2 == 0 else 300) for i in range(200)} and met == [(2, 6)]
    spots = places.select("place", "place_lat", "place_lon", F.when(F.col("place") == 0, 0.9).otherwise(0.1).alias("crowd"), F.lit(True).alias("is_open"))
    none = spark.createDataFrame([(-1, 0)], "place int, v int")
    asked = points.select(F.col("pid").alias("rid"), F.lit(0).alias("busy"), "lat", "lon")
    out = X.calmer_places(asked, spots, none.withColumnRenamed("v", "category"), none.withColumnRenamed("v", "alias"), none.toDF("a", "b"), "rid").collect()
    assert {x.rid: x.place for x in out} == {i: 3 if i % 2 == 0 else 1 for i in range(200)} and met[1] == (2, 6)


def test_f6_means_hang_on_no_order(spark):
    """Means at exact halves of the last digit: neighbours are added from the greatest down, and rounded as SQL rounds."""
    r = random.Random(3)
    cents = {k: 50 + 100 * r.randrange(-2000, 9000) for k in range(600)}
    value = {k: c / 100 / 10000 for k, c in cents.items()}
    near = {k: set() for k in cents}
    for k in cents:
        for o in {k // 2, k // 3, k - 2} & cents.keys() - {k}:
            near[k].add(o)
            near[o].add(k)
    want, halves = {}, 0
    for k, others in near.items():
        total = 0.0
        for o in sorted(others, reverse=True):
            total += value[o]
        x = total / len(others) * 10000
        want[k] = f"{math.copysign(math.floor(abs(x)) + (abs(x) % 1 >= 0.5), x) / 10000:.4f}"
        halves += sum(cents[o] for o in others) % (100 * len(others)) == 50 * len(others)
    rows = [(k, "", k % 25, c / 100) for k, c in cents.items()]
    r.shuffle(rows)
    supplier = spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    got = {int(x.node): x["mean"].split(",")[2] for x in W.gr14_grown_graph(supplier).collect()}
    assert halves > 90 and got == want


def test_f22_few_rules_are_columns(spark, monkeypatch):
    """A small table of rules makes no join and no pattern a row, and gives what the joined one does."""
    from quillspark.operators import rules as Q

    made = [Q.rule("a", 1, 2, "first", [Q.when("x", "above", low=2)], choice="one"), Q.rule("b", 2, 3, "second", [Q.when("name", "word", "ox"), Q.when("name", "is", "cow")], choice="one"), Q.rule("c", 2, 1, None, [Q.when("x", "present", negated=True)], rule_set="s", per="y", factor=0.5, most=3)]
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else float(i % 5), ["ox", "cow", "box", None][i % 4], i % 7, "s" if i % 2 else None) for i in range(60)], "id int, x double, name string, y int, kind string")
    facts = {c: F.col(c) for c in ("x", "name", "y")}
    show = lambda: Q.evaluate(rows, *Q.tables(spark, made), facts, F.col("kind"))
    few = show()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(Q, "MOST_INLINE", -1)
    want = show()
    key = lambda r: r.id
    assert "Join" not in plan and few.schema.simpleString() == want.schema.simpleString() and sorted(few.collect(), key=key) == sorted(want.collect(), key=key)


def test_f18_a_pair_is_scored_once(spark, monkeypatch):
    """Degrees, backbone and rows read written pairs: the result's plan scores none, and lengths come from suppliers."""
    from quillspark.plans import persona_queries as Q

    r = random.Random(4)
    supplier = spark.createDataFrame([(i, i % 3) for i in range(30)], "s_suppkey long, s_nationkey int")
    emb = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(28)], "vec_id long, embedding array<float>")
    out = Q.gr15_graph_context(supplier, None, emb)
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    e = {x.vec_id: x.embedding for x in emb.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(e[a], e[b]))
    got = {(x.u, x.v): x.attention for x in out.collect()}
    assert got.keys() == {(a, b) for a in e for b in e if a < b and a % 3 == b % 3}
    for (a, b), x in got.items():
        c = (dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) + 1) / 2 * (1.35 if a % 2 == 0 and b % 5 else 1)
        assert x == pytest.approx(max(0.15, c), abs=6e-5)


def test_f11_to_f26_sizes_come_with_the_postings(spark, monkeypatch):
    """Documents are read for their words once, and their texts are not shuffled for few hits."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "x ² 7 beta beta gamma"), (4, "")], "doc_id long, text string")
    made = {(r["doc_id"], r["term"], r["n"], r["tf"]) for r in R.postings(docs, "doc_id", spark.createDataFrame([("beta",)], "term string"), marked=True).collect()}
    assert made == {(1, "", 2, 1), (2, "", 0, 1), (3, "", 4, 1), (4, "", 0, 1), (1, "beta", 2, 1), (3, "beta", 4, 2)}
    asked = spark.createDataFrame([(9, "beta")], "item_id long, text string")
    passes = []
    made_of = R.postings
    monkeypatch.setattr(R, "postings", lambda *a, **k: passes.append(k) or made_of(*a, **k))
    hits = {r["doc_id"]: r["score"] for r in R.bm25(docs, asked, "doc_id", "item_id").collect()}
    idf = math.log((4 - 2 + 0.5) / (2 + 0.5) + 1)
    part = lambda tf, n: round(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 1.5)), 6)
    assert hits == {1: part(1, 2), 3: part(2, 4)} and passes == [{"marked": True}]


def test_f21_services_and_likeness_in_one_sum(spark, monkeypatch):
    """Function matches never make a row of a pair of question and document; results are those of the pairs."""
    from quillspark.operators import fusion as M
    from quillspark.plans import search_queries as Q

    rng = random.Random(21)
    words = [f"longserviceword{i}" for i in range(6)] + [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = Q._forms(spark.createDataFrame([(i, text(rng.randrange(0, 9))) for i in range(300)] + [(900, None)], "doc_id long, text string"), "doc_id")
    asked = Q._forms(spark.createDataFrame([(i, text(4)) for i in range(15)], "item_id long, text string"), "item_id")
    like = {(r[0], r[1]): r[2] for r in R.tfidf_scores(docs.select("doc_id", "text"), asked.select("item_id", "text"), "doc_id", "item_id").collect()}
    long_words = lambda rows: {r[0]: {w for w in (r["form"] or "").split() if len(w) >= Q.SERVICE} for r in rows.collect()}
    places, pairs = long_words(docs), []
    for q, mine in long_words(asked).items():
        pairs += [(q, d, len(mine & w), like.get((q, d), 0.0)) for d, w in places.items() if mine & w]
    scores = spark.createDataFrame(pairs, "q long, d long, n long, s double").select("q", "d", M.function_score(F.col("n"), F.col("s")).alias("score")).collect()
    want = set()
    for q in {p[0] for p in pairs}:
        best = sorted((-r["score"], r["d"]) for r in scores if r["q"] == q)[:5]
        want |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(best)}
    monkeypatch.setattr(R, "tfidf_scores", None)
    assert {(r["item_id"], r["doc_id"], r["score"], r["rank"]) for r in Q._function_hits(asked, docs, 5).collect()} == want
    ties = [(n, s / 1e6) for n in range(4) for s in range(0, 1_000_000, 499)] + [(1, 0.1505), (0, 0.0005), (0, 0.0015), (3, 0.9995)]
    plain = spark.createDataFrame(ties, "n long, s double").select(M.function_score(F.col("n"), F.col("s")).alias("x")).toPandas()["x"]
    n, s = (np.array(c, float) for c in zip(*ties))
    assert (plain.to_numpy() == M.function_scores(n, s)).all()


def test_f11_large_files_are_dealt_in_shares(spark, monkeypatch, tmp_path):
    """A few large files go to more tasks than cores, small ones to as many."""
    from quillspark.sources import tables as S

    spark.range(20_000).coalesce(1).write.parquet(f"{tmp_path}/a b")
    df, cores = spark.read.parquet(f"{tmp_path}/a b"), spark.sparkContext.defaultParallelism
    assert S.spread(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(S, "SPREAD_BYTES", 2_000)
    assert S.spread(df).rdd.getNumPartitions() > cores


def test_f12_to_f25_tokens_are_counted_in_their_row(spark, monkeypatch):
    """Postings shuffle nothing where ids are of one row; rows of one id and size still count as one document."""
    monkeypatch.setattr(R, "COUNTED", 7)
    r = random.Random(12)
    texts = [" ".join(r.choice(["alpha", "Beta", "x", "7", "é1", "gamma_2"]) for _ in range(r.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, None), (61, "")], "doc_id long, text string")
    words = [[w.lower() for w in (t or "").split() if w != "x"] for t in [*texts, None, ""]]
    want = {(i, w, len(ws), ws.count(w)) for i, ws in enumerate(words) for w in ws}
    got = R.postings(docs, "doc_id")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(x) for x in got.select("doc_id", "term", "n", "tf").collect()) == sorted(want)
    asked = spark.createDataFrame([("beta",), ("é1",), ("unheard",)], "term string")
    marks = {(i, "", len(ws), 1) for i, ws in enumerate(words)}
    some = R.postings(docs, "doc_id", asked, marked=True).select("doc_id", "term", "n", "tf").collect()
    assert sorted(tuple(x) for x in some) == sorted({x for x in want if x[1] in ("beta", "é1")} | marks)
    twice = R.postings(docs.union(docs), "doc_id", marked=True).select("doc_id", "term", "n", "tf").collect()
    assert sorted(tuple(x) for x in twice) == sorted((*x[:3], 2 * x[3]) for x in want | marks)
