"""Queries of state kept from events: visits, sessions, latest values, time of day."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.operators import state as ST

from .register import query

VISIT_CTE = """
e AS (SELECT *, event_type = lag(event_type) OVER w AS same0, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT user_id, event_type, sum(CASE WHEN coalesce(same0, false) THEN 0 ELSE 1 END)::BIGINT AS visits, sum(CASE WHEN same0 AND gap < {gap}000000 THEN gap / 60e6 ELSE 0.0 END) AS dwell FROM e GROUP BY ALL)"""


@query("events", sql=f"WITH {VISIT_CTE.format(gap=300)} SELECT user_id, event_type, visits, round(dwell, 6) AS dwell FROM v")
def w7_dwell_batch(events):
    return ST.visits(events, "user_id", "event_type", "ts", "event_id").withColumn("dwell", F.round("dwell", 6))


@query("events", sql=f"WITH {VISIT_CTE.format(gap=300)} SELECT user_id, event_type, round(0.5 * (1 - exp(-0.15 * dwell / greatest(1, visits))) + 0.2 * least(1.0, ln(1 + visits) / ln(31)), 3) AS weight FROM v")
def s22_visit_weight(events):
    return ST.weighted_visits(events, "user_id", "event_type", "ts", "event_id").select("user_id", "event_type", "weight")


@query("events", sql=f"""WITH {VISIT_CTE.format(gap=300)}, w AS (SELECT user_id, event_type, round(0.5 * (1 - exp(-0.15 * dwell / greatest(1, visits))) + 0.2 * least(1.0, ln(1 + visits) / ln(31)), 3) AS x FROM v)
SELECT user_id, event_type, round(8 * (1 / (1 + exp(-10 * (x - 0.5))) - 1 / (1 + exp(5))) / (1 / (1 + exp(-5)) - 1 / (1 + exp(5))), 3) AS boost FROM w""")
def s23_history_boost(events):
    v = ST.weighted_visits(events, "user_id", "event_type", "ts", "event_id")
    return v.select("user_id", "event_type", S.history_boost(F.col("weight")).alias("boost"))


@query("events", sql="SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events")
def st3_rate_guard(events):
    """Events of the user in the hour up to each."""
    return events.select("user_id", "event_id", ST.rate(events, "user_id", "ts", 3600).alias("n"))


@query("events", sql="""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 300000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def st11_sessions(events):
    return ST.sessions(events, "user_id", "ts")


@query("events", sql="SELECT event_type, arg_max(greatest(0, least(1, value / 100)), struct_pack(t := ts, i := event_id)) AS level FROM events GROUP BY event_type")
def st4_last_value(events):
    level = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 100))
    return ST.latest(events.select("event_type", level.alias("level"), "ts", "event_id"), ["event_type"], "ts", "event_id").select("event_type", "level")


@query("events", sql="SELECT user_id, event_type, arg_max(value, struct_pack(t := ts, i := event_id)) AS value FROM events GROUP BY ALL")
def k5_latest_upsert(events):
    return ST.latest(events.select("user_id", "event_type", "value", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "value")


@query("events", sql="SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def k6_toggle(events):
    return ST.toggled_on(events, "user_id", "event_type")


@query("events", sql="SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def f7_ttl(events):
    last = events.agg(F.max("ts").alias("m"))
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts")).crossJoin(F.broadcast(last)).filter(F.col("last_ts") > F.col("m") - F.expr("INTERVAL 48 HOURS")).select("user_id", "last_ts")


@query("events", sql="SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def st8_daily(events):
    return events.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).select(F.col("w.start").alias("day"), "n", "users")


@query("events", sql="SELECT (isodow(ts) >= 6) AS weekend, count(*)::BIGINT AS n FROM events GROUP BY 1")
def s25_weekend(events):
    return events.groupBy(S.is_weekend(F.col("ts")).alias("weekend")).agg(F.count("*").alias("n"))


#: Opening hours: name, from, to.
HOURS = (("day", "08:00", "17:30"), ("night", "20:00", "02:00"), ("odd", "xx", "10:00"))


@query("events", sql="""WITH m AS (SELECT hour(ts) * 60 + minute(ts) AS m FROM events)
SELECT 'day' AS rule, count(*) FILTER (m BETWEEN 480 AND 1050)::BIGINT AS open_n FROM m UNION ALL SELECT 'night', count(*) FILTER (m >= 1200 OR m <= 120)::BIGINT FROM m UNION ALL SELECT 'odd', count(*)::BIGINT FROM m""")
def f1_open_now(events):
    """How many events fall in each rule's hours; hours that can't be read are always open."""
    now = F.hour("ts") * 60 + F.minute("ts")
    opens = [F.struct(F.lit(n).alias("rule"), S.open_now(now, S.minutes_of_day(F.lit(a)), S.minutes_of_day(F.lit(b))).alias("is_open")) for n, a, b in HOURS]
    rows = events.select(F.explode(F.array(*opens)).alias("x")).select("x.*")
    return rows.groupBy("rule").agg(F.count(F.when(F.col("is_open"), 1)).alias("open_n"))


@query("events", sql="SELECT event_id, ((1320 - (hour(ts) * 60 + minute(ts))) % 1440 + 1440) % 1440 AS left_min FROM events")
def s24_minutes_to_close(events):
    return events.select("event_id", S.minutes_to_close(F.hour("ts") * 60 + F.minute("ts"), F.lit(22 * 60)).cast("long").alias("left_min"))


@query("events", sql="SELECT event_id, CASE WHEN v >= 0.85 THEN 'packed' WHEN v >= 0.6 THEN 'busy' WHEN v >= 0.35 THEN 'moderate' ELSE 'quiet' END AS label FROM (SELECT event_id, 0.4 * 0.5 + 0.6 * least(1, value / 100) AS v FROM events)")
def s28_crowd_label(events):
    """A fixed forecast blended with the live report."""
    return events.select("event_id", S.crowd_label(0.4 * 0.5 + 0.6 * F.least(F.lit(1.0), F.col("value") / 100)).alias("label"))


@query("events", sql="SELECT event_type, week, round(sum(value), 4) AS total, round(sum(sum(value)) OVER (PARTITION BY event_type ORDER BY week), 4) AS running FROM (SELECT event_type, weekofyear(ts)::INTEGER AS week, value FROM events) GROUP BY event_type, week")
def st5_running_total(events):
    weekly = events.groupBy("event_type", F.weekofyear("ts").alias("week")).agg(F.sum("value").alias("t"))
    w = Window.partitionBy("event_type").orderBy("week")
    return weekly.select("event_type", "week", F.round("t", 4).alias("total"), F.round(F.sum("t").over(w), 4).alias("running"))


@query("events", sql="SELECT event_id, 'arrived' AS status FROM events WHERE event_type = 'purchase' AND value < 5")
def st7_arrivals(events):
    return events.filter("event_type = 'purchase' AND value < 5").select("event_id", F.lit("arrived").alias("status"))


@query("events", sql="SELECT user_id, event_type FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY ALL EXCEPT SELECT user_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 48 HOUR GROUP BY ALL")
def st2_expired(events):
    """Keys not seen in the last 48 hours."""
    last = events.agg(F.max("ts").alias("m"))
    return events.groupBy("user_id", "event_type").agg(F.max("ts").alias("t")).crossJoin(F.broadcast(last)).filter(F.col("t") <= F.col("m") - F.expr("INTERVAL 48 HOURS")).select("user_id", "event_type")
