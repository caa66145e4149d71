"""Edges of the scalar functions, chunk packing, fusion and streams."""

import math
import random

import pytest
from hypothesis import given
from hypothesis import settings as hyp
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.operators import chunking, evaluation, graphs, retrieval, state
from quillspark.plans.text_queries import first_marker
from quillspark.streaming import visits


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_detour_edges(spark):
    d = [0.0, 60.0, 60.1, 120.0, 120.1]
    r = spark.createDataFrame([(x,) for x in d], "d double").select(F.round(S.detour(F.col("d"), F.lit(0.0), F.lit(0.0)), 3).alias("s")).collect()
    assert [x.s for x in r] == [18.0, 0.0, 4.992, 0.0, -5.0]


def test_hours(spark):
    r = one(spark, bad=S.minutes_of_day(F.lit("25:00")), none=S.minutes_of_day(F.lit("x")), t=S.minutes_of_day(F.lit("09:30")),
            night=S.open_now(F.lit(30), F.lit(1200), F.lit(120)), day=S.open_now(F.lit(30), F.lit(480), F.lit(1050)), left=S.minutes_to_close(F.lit(1430), F.lit(10)), never=S.minutes_to_close(F.lit(5), F.lit(1439)))
    assert (r.bad, r.none, r.t, r.night, r.day, r.left, r.never) == (None, None, 570, True, False, 20, None)


def test_geography(spark):
    r = one(spark, d=S.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), c=S.compass(S.bearing(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))), n=S.compass(F.lit(350.0)))
    assert abs(r.d - 111194.93) < 0.01 and r.c == "E" and r.n == "N"


def test_score_clip_and_boost(spark):
    r = one(spark, a=S.clip_score(F.lit(90.0)), b=S.clip_score(F.lit(-1.0)), lo=S.history_boost(F.lit(0.0)), hi=S.history_boost(F.lit(1.0)))
    assert (r.a, r.b, r.lo, r.hi) == (100.0, 0.0, 0.0, 8.0)


def test_text_edges(spark):
    r = one(spark, t=T.tokens(F.lit("A bc 7 _ ÀÉ!")), none=T.tokens(F.lit(None).cast("string")), f=T.fold(F.lit("Đường Ấn")), w=F.size(T.windows(F.lit(""))), o=T.overlap(F.array().cast("array<string>"), F.array(F.lit("a"))))
    assert r.t == ["bc", "7", "àé"] and r.none == [] and r.f == "duong an" and r.w == 0 and r.o == 1.0


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc .!?", min_size=1, max_size=300), max_size=30))
def test_chunks_fit(parts):
    chunks = chunking.pack(" ".join(parts))
    assert all(len(c) <= chunking.LARGEST for c in chunks)


@hyp(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_length(a, b):
    n = evaluation.common_length(a, b)
    assert n == evaluation.common_length(b, a) <= min(len(a), len(b))


def test_minmax_constant_and_mmr(spark):
    hits = spark.createDataFrame([(1, i, 2.0, ["x"]) for i in range(4)], "q long, item long, score double, words array<string>")
    assert {r.norm_score for r in retrieval.min_max(hits, "q").collect()} == {0.5}
    rows = [(1, 1, 1.0, ["a", "b"]), (1, 2, 0.9, ["a", "b"]), (1, 3, 0.8, ["c"])]
    got = retrieval.select_diverse(spark.createDataFrame(rows, hits.schema), "q", 2).orderBy("place").collect()
    assert [r["item"] for r in got] == [1, 3]


def test_paths_skip_closed(spark):
    e = spark.createDataFrame([(1, 2, 1.0, "open"), (2, 3, 1.0, "closed"), (1, 3, 9.0, "open"), (3, 1, 1.0, None)], "src int, dst int, weight double, status string")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {r.node: r.cost for r in graphs.shortest_paths(e, seeds).collect()} == {1: 0.0, 2: 1.0, 3: 9.0}


def test_pagerank_keeps_its_sum(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (1, 3, 1.0)], "src int, dst int, weight double")
    r = graphs.personal_pagerank(e, spark.createDataFrame([(1,)], "node int"), 5).collect()
    assert abs(sum(x["rank"] for x in r) - 1) < 1e-9


def test_visit_gaps(spark):
    rows = [(1, 0, "a", 0), (1, 1, "a", 299), (1, 2, "a", 599), (1, 3, "b", 600), (1, 4, "a", 601)]
    df = spark.createDataFrame(rows, "u long, i long, p string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.p: (r.visits, round(r.dwell, 4)) for r in state.visits(df, "u", "p", "ts", "i").collect()}
    assert got == {"a": (2, round(299 / 60, 4)), "b": (1, 0.0)}


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_of_visits_equals_batch(spark, tmp_path, parts):
    rng = random.Random(3)
    rows = sorted((rng.randrange(4000), rng.randrange(3), rng.choice("abc")) for _ in range(120))
    schema = "s long, user_id long, place string"
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("user_id", F.timestamp_seconds("s").alias("ts"), "place")
    seen = {}

    def keep(df, _):
        seen.update({(r.user_id, r.place): (r.visits, round(r.dwell, 6)) for r in df.collect()})

    q = visits.visit_updates(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    batch = spark.read.schema(schema).parquet(f"{tmp_path}/in").select("user_id", F.timestamp_seconds("s").alias("ts"), "place", "s")
    want = {(r.user_id, r.place): (r.visits, round(r.dwell, 6)) for r in state.visits(batch, "user_id", "place", "ts", "s").collect()}
    assert seen.keys() == want.keys()
    assert sum(v for v, _ in seen.values()) > 0
    if len({(r[0], r[1]) for r in rows}) == len(rows):  # no ties in time
        assert seen == want


def test_first_marker(spark):
    """The first rule in order counts, not the first place in the text; nulls, long matches and clean texts."""
    rows = [
        (0, "As far as I know, I think so"),
        (1, "Theo tôi nghĩ là vậy"),
        (2, "It is PROBABLY\nwhat they are"),
        (3, "I'm not   sure"),
        (4, "The maybe of it"),
        (5, None),
        (6, ""),
        (7, "my" + " " * 90 + "knowledge cutoff"),
    ]
    got = spark.createDataFrame(rows, "i int, text string").select("i", first_marker(F.col("text")).alias("m")).collect()
    want = {0: "i think", 1: "theo toi nghi", 2: "probably\nwhat they are", 3: "i'm not   sure", 4: None, 5: None, 6: None, 7: "my" + " " * 78}
    assert {r.i: r.m for r in got} == want


def test_topic_scores(spark):
    """Entities without weight, clusters counted once a chunk, a chunk without entities."""
    weights, clusters = {1: 2.0, 2: 0.5}, {1: 7, 2: 7, 3: 8, 4: 7}
    members = [(1, 10), (2, 10), (3, 10), (4, 11), (3, 12), (1, 10)]
    frames = [([(c, 1.5) for c in (10, 11, 12, 13)], "chunk int, score double"), (members, "entity int, chunk int"), (list(weights.items()), "entity int, w double"), (list(clusters.items()), "entity int, cluster int")]
    got = {r.chunk: r.score for r in graphs.topic_scores(*(spark.createDataFrame(*f) for f in frames)).collect()}
    for chunk in (10, 11, 12, 13):
        own = {e for e, c in members if c == chunk}
        means = [sum(weights.get(e, 0.0) for e in clusters if clusters[e] == k) / sum(1 for e in clusters if clusters[e] == k) for k in {clusters[e] for e in own}]
        assert got[chunk] == pytest.approx(1.5 + 0.3 * sum(math.log1p(weights.get(e, 0.0)) for e in own) + 0.2 * math.log1p(sum(means)))
