"""Models that learn from feedback, incremental reads, and visits from pings."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import online as O
from quillspark.sources.versions import Versions, new_rows, scratch
from quillspark.streaming import tracking as K

from .register import query


def feedback_of(emb):
    """(key, id, embedding, alpha, reward): each vector as rated feedback to the model of its label."""
    k = F.col("vec_id")
    return emb.select(F.col("label").cast("string").alias("key"), k.alias("id"), "embedding", (k * 37 % 101 / 100).alias("alpha"), ((k % 5 - 2) / 2).alias("reward"))


@query("embeddings")
def v10_online_alpha(emb):
    """The mixing weight that each vector gets from its label's model, after all vectors' feedback has come in by two updates."""
    models = O.AlphaModels(Versions(emb.sparkSession, scratch(emb.sparkSession, "alpha")), 64, rate=0.05)
    feedback = feedback_of(emb)
    middle = feedback.agg(F.expr("percentile_approx(id, 0.5)")).first()[0] or 0
    models.update(feedback.filter(F.col("id") <= middle))
    models.update(feedback)
    return models.predict(emb.select(F.col("label").cast("string").alias("key"), "vec_id", "embedding")).select("vec_id", F.round("alpha", 6).alias("alpha"))


@query("events", sql="SELECT event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total, 3::BIGINT AS version, (SELECT max(event_id) FROM events) AS last_id FROM events GROUP BY event_type")
def st6_incremental_totals(events):
    """Totals by type from three reads, each of the rows after the id that the version before it stored."""
    schema = "event_type string, n long, total double"
    store = Versions(events.sparkSession, scratch(events.sparkSession, "totals"))
    ends = events.agg(F.expr("percentile_approx(event_id, array(0.3, 0.6))").alias("p"), F.max("event_id").alias("m")).first()
    for end in [*(ends.p or []), ends.m]:
        version = store.latest()
        new = new_rows(events.filter(F.col("event_id") <= end), "event_id", store.last_id(version))
        found = new.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        merged = store.read("totals", schema, version).unionByName(found).groupBy("event_type").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        store.write({"totals": merged}, end)
    version = store.latest()
    return store.read("totals", schema).select("event_type", "n", F.round("total", 4).alias("total"), F.lit(version).cast("long").alias("version"), F.lit(store.last_id(version)).cast("long").alias("last_id"))


def pings_of(events):
    """Events as pings near places, time running 200 times as fast; sign-ups are searches."""
    k = F.get_json_object("props", "$.k").cast("long")
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    ts = F.timestamp_micros(start + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 200))
    name = lambda c: F.concat(F.lit("P"), F.lpad(c.cast("string"), 3, "0"))
    return events.select(
        "user_id",
        "event_id",
        ts.alias("ts"),
        (10 + F.floor(k / 25) % 4 * 0.001 + F.col("event_id") % 5 * 0.00006).alias("lat"),
        F.lit(106.0).alias("lon"),
        F.when(F.col("event_id") % 3 == 0, name(k % 4)).alias("destination"),
        F.when(F.col("event_id") % 7 == 0, name(F.lit(2))).alias("scheduled"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("way to "), name(k % 4), F.lit("?"))).alias("search"),
    )


def places_of(supplier):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("building", "admin", "gate", "building"))), (k % 4 + 1).cast("int"))
    return supplier.select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 3, "0")).alias("place"), (10 + k % 40 * 0.001).alias("lat"), F.lit(106.0).alias("lon"), kind.alias("kind"))


SNAP_CTE = """
g AS (SELECT user_id, event_id, (epoch_us(TIMESTAMP '2024-01-01') + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 200)::BIGINT AS us, 10 + (k // 25) % 4 * 0.001::DOUBLE + event_id % 5 * 0.00006::DOUBLE AS lat,
  CASE WHEN event_id % 3 = 0 THEN 'P' || lpad((k % 4)::VARCHAR, 3, '0') END AS destination, CASE WHEN event_id % 7 = 0 THEN 'P002' END AS scheduled, CASE WHEN event_type = 'signup' THEN 'way to P' || lpad((k % 4)::VARCHAR, 3, '0') || '?' END AS search
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
l AS (SELECT 'P' || lpad(s_suppkey::VARCHAR, 3, '0') AS place, 10 + s_suppkey % 40 * 0.001::DOUBLE AS plat, s_suppkey % 4 <> 2 AS eligible FROM supplier),
d AS (SELECT g.*, place, eligible, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT *, pow(sin(radians(plat - lat) / 2), 2) AS h FROM (SELECT DISTINCT lat FROM g) x, l) y JOIN g USING (lat)),
s AS (SELECT event_id, any_value(user_id) AS user_id, any_value(us) AS us, any_value(destination) AS destination, any_value(scheduled) AS scheduled, any_value(search) AS search, min({'m': metres, 'p': place, 'e': eligible}) AS best FROM d WHERE metres <= 1000 GROUP BY event_id)"""


@query("events", "supplier", sql=f"""WITH {SNAP_CTE},
p AS (SELECT *, best.p AS place, best.m AS metres, best.p = lag(best.p) OVER w AS same0, us - lag(us) OVER w AS gap FROM s WHERE search IS NULL WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
v AS (SELECT p.*, coalesce(same0, false) AS same, coalesce(place = destination, false) OR coalesce(place = scheduled, false) OR coalesce((SELECT bool_or(contains(q.search, p.place)) FROM (SELECT z.search, row_number() OVER (ORDER BY z.us DESC, z.event_id DESC) AS back FROM s z WHERE z.user_id = p.user_id AND z.search IS NOT NULL AND (z.us, z.event_id) < (p.us, p.event_id)) q WHERE back <= 3), false) AS meant FROM p)
SELECT user_id, place, sum(CASE WHEN same THEN 0 ELSE 1 END)::BIGINT AS visits, sum(CASE WHEN NOT same AND meant THEN 1 ELSE 0 END)::BIGINT AS intended, round(sum(CASE WHEN same AND gap < 300000000 THEN gap / 60e6 ELSE 0 END), 6) AS dwell
FROM v WHERE best.e AND metres < 25 GROUP BY user_id, place""")
def st1_visits(events, supplier):
    """Each user's visits of places, how many were meant, and minutes there, from pings snapped to the nearest place."""
    rows = K.snapped(pings_of(events), places_of(supplier))
    return K.visits_of(rows).select("user_id", "place", "visits", "intended", F.round("dwell", 6).alias("dwell"))


@query("events", "supplier", sql=f"WITH {SNAP_CTE} SELECT user_id, event_id, best.p AS place, best.m AS metres FROM s WHERE search IS NULL AND best.p = destination AND best.m < 5")
def st7_destination_arrivals(events, supplier):
    """Pings whose nearest place is their destination, less than five metres off."""
    return K.arrivals_of(K.snapped(pings_of(events), places_of(supplier)))
