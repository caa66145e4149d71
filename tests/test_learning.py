"""Online models, versions and the visit tracker against plain loops, in any split of the stream and after restarts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import online as O
from quillspark.sources.versions import Versions, new_rows
from quillspark.streaming import tracking as K

FEEDBACK = "key string, id long, embedding array<float>, alpha double, reward double"


def some_feedback(n=500, dim=6, seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), i * 2, [float(np.float32(r.gauss(0, 1))) for _ in range(dim)], r.choice([0.0, 0.31, 0.5, 0.999, 1.4]), r.choice([-1.0, -0.5, 0.0, 0.5, 1.0])) for i in range(n)]
    rows[10] = (*rows[10][:2], None, *rows[10][3:])
    rows[11] = (*rows[11][:2], [1.0], *rows[11][3:])
    rows[12] = (*rows[12][:4], None)
    return rows


def plain_models(rows, dim=6, rate=0.05):
    models = {}
    for key, _, x, alpha, reward in sorted(rows, key=lambda r: r[1]):
        w, b, n = models.setdefault(key, [np.zeros((101, dim)), np.zeros(101), 0])
        if x is None or len(x) != dim or alpha is None or not reward:
            continue
        x = np.array(x)
        average = lambda v: np.array([sum(v[min(100, max(0, i + d))] for d in range(-3, 4)) / 7 for i in range(101)])
        s = average(w @ x + b)
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        target = np.zeros(101)
        target[min(100, max(0, round(alpha * 100))) if reward > 0 else 50] = 1
        g = average(target - p) * rate * abs(reward)
        models[key] = [w + np.outer(g, x), b + g, n + 1]
    return models


def same_models(models, want):
    got = {r.key: r for r in models.latest().collect()}
    assert got.keys() == want.keys()
    for key, (w, b, n) in want.items():
        assert got[key].updates == n
        np.testing.assert_allclose(np.array(got[key].weights).reshape(w.shape), w, atol=1e-12)
        np.testing.assert_allclose(got[key].bias, b, atol=1e-12)


def test_models_equal_a_plain_loop_after_restarts(spark, tmp_path):
    rows = some_feedback()
    df = spark.createDataFrame(rows, FEEDBACK).repartition(5)
    at = f"file://{tmp_path}/models"
    models = O.AlphaModels(Versions(spark, at), 6, 0.05)
    assert models.update(df.filter("id < 0")) == 0 and models.update(df.filter("id < 400")) == 1
    models = O.AlphaModels(Versions(spark, at), 6, 0.05)  # a restart, which gets the same rows again
    assert models.update(df.filter("id < 400")) == 1 and models.update(df.filter("id < 401")) == 2
    models.versions.write({"models": models.latest().limit(0)}, 10**6)  # a writer that is lost before its mark ...
    fs, mark = models.versions._fs(f"{at}/version=3/mark")
    fs.delete(mark, True)
    assert models.versions.latest() == 2 and models.update(df) == 3  # ... leaves nothing that is read
    assert models.versions.last_id() == 998
    same_models(models, plain_models(rows))
    models.versions.drop_before(3)
    same_models(models, plain_models(rows))


def test_models_of_a_stream(spark, tmp_path):
    rows = some_feedback(120)
    models = O.AlphaModels(Versions(spark, f"file://{tmp_path}/models"), 6, 0.05)

    def run():
        stream = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = stream.writeStream.foreachBatch(lambda batch, _: models.update(batch) and None).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None

    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], FEEDBACK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    same_models(models, plain_models(rows))


def test_predictions(spark, tmp_path):
    rows = some_feedback(200)
    models = O.AlphaModels(Versions(spark, f"file://{tmp_path}/models"), 6, 0.05)
    models.update(spark.createDataFrame(rows, FEEDBACK))
    want = plain_models(rows)
    asked = [*((k, i, x) for k, i, x, *_ in rows), ("new", 9999, rows[0][2])]
    got = {r.vec_id: (r.key, r.alpha) for r in models.predict(spark.createDataFrame(asked, "key string, vec_id long, embedding array<float>")).collect()}
    assert len(got) == len(asked)
    for key, i, x in asked:
        expected = 0.5
        if key in want and x is not None and len(x) == 6:
            w, b, _ = want[key]
            s = O.smoothed(w @ np.array(x) + b)
            expected = float(np.exp(s) @ np.linspace(0, 1, 101) / np.exp(s).sum())
        assert got[i][0] == key and got[i][1] == pytest.approx(expected, abs=1e-9)


def test_new_rows_reach_the_scan_as_a_filter(spark, sf, capsys):
    new_rows(spark.read.parquet(f"{sf}/events.parquet"), "event_id", 7).explain("formatted")
    assert "GreaterThan(event_id,7)" in capsys.readouterr().out


PINGS = "user_id long, event_id long, s double, lat double, lon double, destination string, scheduled string, search string"
PLACES = [("gate", 10.0, 106.0, "gate"), ("hall", 10.001, 106.0, "building"), ("lab", 10.0015, 106.0, "admin"), ("twin", 10.001, 106.0, "building"), ("far", 10.5, 106.0, "building"), ("none", None, None, "building")]


def some_pings(n=300, seed=5, step=130):
    r = random.Random(seed)
    rows, s = [], 0.0
    for i in range(n):
        s += r.expovariate(1 / step)
        near = r.choice(PLACES[:3])
        lat = r.choice([near[1] + r.uniform(-4e-4, 4e-4), near[1] + r.uniform(-2e-5, 2e-5), 11.7, None])
        search = f"to the {r.choice(PLACES)[0]}" if r.random() < 0.2 else None
        rows.append((r.randrange(3), i, round(s, 3), lat, 106.0, r.choice(["hall", "lab", None]), r.choice(["lab", None]), search))
    return rows


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h)), 3)


def plain_visits(rows):
    users, totals, arrived = {}, {}, set()
    for u, i, s, lat, lon, destination, scheduled, search in sorted(rows, key=lambda r: (r[2], r[1])):
        last, searches = users.setdefault(u, [None, []])
        if search is not None:
            searches.append(search)
            continue
        near = [(m, p[0], p[3]) for p in PLACES if p[1] is not None and lat is not None and (m := metres((lat, lon), p[1:3])) <= 1000]
        m, place, kind = min(near) if near else (None, None, None)
        same = last is not None and last[0] == place
        minutes = (s - last[1]) / 60 if same and round(s - last[1], 6) < 300 else 0.0
        users[u][0] = (place, s)
        if place is not None and place == destination and m < 5:
            arrived.add((u, i, place))
        if place is not None and kind in ("building", "admin") and m < 25:
            t = totals.setdefault((u, place), [0, 0, 0.0])
            t[0] += not same
            t[1] += not same and (place in (destination, scheduled) or any(place in x for x in searches[-3:]))
            t[2] += minutes
    return {k: (v, n, round(d, 6)) for k, (v, n, d) in totals.items()}, arrived


def frame(spark, rows):
    return spark.createDataFrame(rows, PINGS).withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("long"))).drop("s")


def test_visits_equal_a_plain_loop(spark):
    rows = some_pings()
    snapped = K.snapped(frame(spark, rows), spark.createDataFrame(PLACES, "place string, lat double, lon double, kind string"))
    want, arrived = plain_visits(rows)
    assert {(r.user_id, r.place): (r.visits, r.intended, round(r.dwell, 6)) for r in K.visits_of(snapped).collect()} == want
    assert {(r.user_id, r.event_id, r.place) for r in K.arrivals_of(snapped).collect()} == arrived and arrived


STORE = "spark.sql.streaming.stateStore.providerClass"


def follow(spark, tmp_path, parts, name, ttl_ms=48 * 3600 * 1000):
    """The last totals and all arrivals of a stream that is stopped after each part."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    totals, arrived = {}, set()

    def keep(df, _):
        for r in df.collect():
            if r.what == "arrived":
                arrived.add((r.user_id, r.event_id, r.place))
            elif r.seq >= totals.get((r.user_id, r.place), (0,))[0]:
                totals[r.user_id, r.place] = (r.seq, r.visits, r.intended, round(r.dwell, 6))

    try:
        places = spark.createDataFrame(PLACES, "place string, lat double, lon double, kind string")
        schema = frame(spark, []).schema
        for part in parts:
            frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
            q = K.track(stream, places, ttl_ms=ttl_ms).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
            assert q.awaitTermination(240) and q.exception() is None
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return {k: v[1:] for k, v in totals.items()}, arrived


def test_tracker_equals_the_batch_in_any_split(spark, tmp_path):
    rows = some_pings(150)
    end = [(u, 10_000 + u, rows[-1][2] + 40_000 + u, None, None, None, None, None) for u in range(3)]
    want = plain_visits(rows)
    mixed = random.Random(2)
    shuffled = sorted(rows, key=lambda r: r[2] + mixed.uniform(0, 550))  # up to 550 s late, the watermark is at 600
    for name, parts in (("whole", [rows, end, end]), ("late", [shuffled[:31], shuffled[31:77], shuffled[77:], end, end])):
        got = follow(spark, tmp_path, [[*p] for p in parts], name)
        assert got == want, name


def test_users_are_forgotten(spark, tmp_path):
    at = lambda i, s: (0, i, float(s), 10.001, 106.0, None, None, None)
    rows = [at(0, 1000), at(1, 1100), at(2, 6000)]  # the last ping comes after the user was forgotten, so it is a new visit
    end = [(0, 9, 30_000.0, None, None, None, None, None)]
    got, _ = follow(spark, tmp_path, [rows, end, end], "ttl", ttl_ms=1_000_000)
    assert got == {(0, "hall"): (1, 0, 0.0)}
    got, _ = follow(spark, tmp_path, [rows, end, end], "kept", ttl_ms=10_000_000)
    assert got == {(0, "hall"): (1, 0, round(100 / 60, 6))}
