"""State from event tables: latest rows, toggles, visits, sessions, rate limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scores import visit_weight


def micros(ts) -> Column:
    """Microseconds of a timestamp with or without a zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; a grouped maximum, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def toggled_on(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys toggled an odd number of times."""
    return rows.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on")).filter("on").drop("on")


def visits(events: DataFrame, user: str, place: str, ts: str, order: str, gap_s: int = 300) -> DataFrame:
    """(user, place, visits, dwell): a ping at another place than the last is a visit; at the same within the gap adds its minutes."""
    w = Window.partitionBy(user).orderBy(ts, order)
    same = F.lag(place).over(w) == F.col(place)
    gap = micros(ts) - micros(F.lag(ts).over(w))
    rows = events.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("gap", gap)
    minutes = F.when(F.col("same") & (F.col("gap") < gap_s * 1_000_000), F.col("gap") / 60e6).otherwise(0.0)
    return rows.withColumn("minutes", minutes).groupBy(user, place).agg(F.sum((~F.col("same")).cast("long")).alias("visits"), F.sum("minutes").alias("dwell"))


def weighted_visits(events: DataFrame, user: str, place: str, ts: str, order: str) -> DataFrame:
    v = visits(events, user, place, ts, order)
    return v.withColumn("weight", visit_weight(F.col("visits"), F.col("dwell") / F.greatest(F.lit(1), F.col("visits")), F.lit(0.0)))


def rate(events: DataFrame, user: str, ts: str, seconds: int) -> Column:
    """Events of the user in the trailing window, the row's own included."""
    w = Window.partitionBy(user).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return F.count("*").over(w)


def sessions(events: DataFrame, user: str, ts: str, gap: str = "5 minutes") -> DataFrame:
    """(user, start, n) of sessions that a pause of the gap ends."""
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("start"), "n")
