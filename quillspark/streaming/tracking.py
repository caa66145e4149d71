"""Visits of places from pings with coordinates: nearest place, dwell, intent, arrival, expiry.

``snapped`` finds each ping's nearest place; ``visits_of`` and ``arrivals_of`` give the totals of a whole
table; ``VisitTracker`` keeps the same totals over a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.scores import haversine, visit_weight
from quillspark.operators.state import micros

#: Metres within which a ping visits its nearest place, and arrives at its destination; a pause that ends a stay; searches that show intent.
NEAR_M, ARRIVED_M, GAP_S, SEARCHES = 25.0, 5.0, 300, 3
#: Metres within which a nearest place is looked for: the side of a grid cell.
REACH_M = 1000.0
_DEGREE_M = 111_195.0
COLUMNS = ("user_id", "event_id", "ts", "destination", "scheduled", "search", "place", "metres", "eligible")


def snapped(pings: DataFrame, places: DataFrame, reach: float = REACH_M, eligible: Column | None = None) -> DataFrame:
    """``COLUMNS`` of pings (user_id, event_id, ts, lat, lon, destination, scheduled, search) with their nearest place, the smaller name among equals.

    ``places`` is (place, lat, lon, kind); ``eligible`` says which count as visited (by default buildings and
    offices). Places stand in grid cells of ``reach`` metres and their neighbours; a ping meets those of its
    own cell in one row, so an equal join does it, and the row needs no group. A ping with no place within
    reach, or without coordinates, has none. Cells narrow with latitude; up to 60 degrees they are wide enough.
    Of places at one spot only the first by name can be nearest, so a spot stands once. In a table (not a stream)
    the nearest place is looked for once for each spot that pings come from.
    """
    side = reach / _DEGREE_M
    eligible = F.col("kind").isin("building", "admin") if eligible is None else eligible
    cell = lambda c, width: F.floor(F.col(c) / width)
    around = lambda c, width: F.explode(F.sequence(cell(c, width) - 1, cell(c, width) + 1))
    rows = places.filter("lat IS NOT NULL AND lon IS NOT NULL").select("place", "lat", "lon", F.coalesce(eligible, F.lit(False)).alias("eligible"))
    spots = rows.groupBy("lat", "lon").agg(F.min(F.struct("place", "eligible")).alias("p")).select("p.place", "lat", "lon", "p.eligible")
    cells = spots.withColumn("y", around("lat", side)).withColumn("x", around("lon", 2 * side))
    cells = cells.groupBy("y", "x").agg(F.collect_list(F.struct("place", "lat", "lon", "eligible")).alias("near"))
    lat, lon = F.col("lat"), F.col("lon")
    ranked = F.transform("near", lambda p: F.struct(F.round(haversine(lat, lon, p["lat"], p["lon"]), 3).alias("metres"), p["place"].alias("place"), p["eligible"].alias("eligible")))
    nearest = F.array_min(F.filter(ranked, lambda p: p["metres"] <= reach))
    asked = pings if pings.isStreaming else pings.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    met = asked.withColumn("y", cell("lat", side)).withColumn("x", cell("lon", 2 * side)).join(cells, ["y", "x"], "left").withColumn("best", nearest)
    if not pings.isStreaming:
        met = pings.join(met.select("lat", "lon", "best"), ["lat", "lon"], "left")
    return met.select("user_id", "event_id", "ts", "destination", "scheduled", "search", F.col("best.place").alias("place"), F.col("best.metres").alias("metres"), F.coalesce("best.eligible", F.lit(False)).alias("eligible"))


def _moves(rows: DataFrame) -> DataFrame:
    """Snapped pings with whether the place is the last one's, the minutes since, and whether the visit was meant."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    own = Window.partitionBy("user_id", F.col("search").isNull()).orderBy("ts", "event_id")
    said = F.struct(*(F.lag("search", back).over(own).alias(f"said{back}") for back in range(SEARCHES)))
    rows = rows.withColumn("_said", F.when(F.col("search").isNotNull(), said))
    pings = rows.withColumn("_said", F.last("_said", ignorenulls=True).over(by_user)).filter("search IS NULL").select("*", "_said.*").drop("_said")
    pings = pings.withColumn("same", F.coalesce(F.lag("place").over(by_user).eqNullSafe(F.col("place")) & (F.lag("event_id").over(by_user).isNotNull()), F.lit(False)))
    gap = micros("ts") - micros(F.lag("ts").over(by_user))
    pings = pings.withColumn("minutes", F.when(F.col("same") & (gap < GAP_S * 1_000_000), gap / 60e6).otherwise(0.0))
    meant = [F.col("place") == F.col("destination"), F.col("place") == F.col("scheduled"), *(F.contains(F.col(f"said{i}"), F.col("place")) for i in range(SEARCHES))]
    found = F.coalesce(meant[0], F.lit(False))
    for m in meant[1:]:
        found = found | F.coalesce(m, F.lit(False))
    return pings.withColumn("meant", found)


def visits_of(rows: DataFrame) -> DataFrame:
    """(user_id, place, visits, intended, dwell, weight) from all snapped pings.

    A ping within ``NEAR_M`` of an eligible place adds the minutes since the last ping, if that was at the
    same place less than ``GAP_S`` ago, and is a new visit if the last ping was elsewhere. Pings anywhere
    move a user on. A visit is intended if the place is the destination or scheduled, or named in one of the
    user's last searches.
    """
    near = _moves(rows).filter(F.col("eligible") & (F.col("metres") < NEAR_M))
    new = ~F.col("same")
    out = near.groupBy("user_id", "place").agg(F.sum(new.cast("long")).alias("visits"), F.sum((new & F.col("meant")).cast("long")).alias("intended"), F.sum("minutes").alias("dwell"))
    return out.withColumn("weight", visit_weight(F.col("visits"), F.col("dwell") / F.greatest(F.col("visits"), F.lit(1)), F.col("intended")))


def arrivals_of(rows: DataFrame) -> DataFrame:
    """(user_id, event_id, place, metres) of pings whose nearest place is their destination, less than ``ARRIVED_M`` away."""
    return rows.filter((F.col("place") == F.col("destination")) & (F.col("metres") < ARRIVED_M) & F.col("search").isNull()).select("user_id", "event_id", "place", "metres")


class VisitTracker(StatefulProcessor):
    """The totals of ``visits_of`` for each user of a stream, with event-time order and expiry.

    Pings wait until the watermark has passed them and are then taken in order of time, so the totals don't
    depend on how a stream is cut into batches or in which order (within the watermark) pings come. A user
    without pings for ``ttl_ms`` of event time is forgotten. Gives a place's totals (what = 'visit') each
    time they change, and arrivals (what = 'arrived'); ``seq`` counts a user's pings, so the row of greatest
    seq is the latest.
    """

    OUTPUT = "user_id long, what string, place string, event_id long, seq long, visits long, intended long, dwell double"

    def __init__(self, ttl_ms: int = 48 * 3600 * 1000):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long, destination string, scheduled string, search string, place string, metres double, eligible boolean")
        self.last = handle.getValueState("last", "begun boolean, place string, us long, seq long, searches array<string>, expires long")
        self.totals = handle.getMapState("totals", "place string", "visits long, intended long, dwell double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [t for df in rows for t in self._tuples(df)]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begun = self.last.exists()
        watermark = timerValues.getCurrentWatermarkInMs()
        if begun and self.last.get()[5] <= expiredTimerInfo.getExpiryTimeInMs() and not self.waiting.exists():
            self.last.clear()
            self.totals.clear()
            return
        yield from self._advance(key, [], watermark)

    @staticmethod
    def _tuples(df: pd.DataFrame) -> list[tuple]:
        none = lambda x: None if pd.isna(x) else x
        us = df["ts"].astype("datetime64[us]").astype("int64")
        return [(int(u), int(e), none(d), none(s), none(q), none(p), None if pd.isna(m) else float(m), bool(g)) for u, e, d, s, q, p, m, g in zip(us, df["event_id"], df["destination"], df["scheduled"], df["search"], df["place"], df["metres"], df["eligible"])]

    def _advance(self, key, new: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        waiting = ([tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []) + new
        due = sorted((x for x in waiting if x[0] // 1000 < watermark), key=lambda x: x[:2])
        left = [x for x in waiting if x[0] // 1000 >= watermark]
        out = []
        begun, place, us, seq, searches, expires = self.last.get() if self.last.exists() else (False, None, 0, 0, [], 0)
        searches = list(searches)
        for at, event_id, destination, scheduled, search, here, metres, eligible in due:
            if expires and at // 1000 >= expires:  # forgotten before this ping
                begun, place, us, searches = False, None, 0, []
                self.totals.clear()
            seq, expires = seq + 1, at // 1000 + self.ttl_ms
            if search is not None:
                searches = [*searches, search][-SEARCHES:]
                continue
            same = begun and here == place
            minutes = (at - us) / 60e6 if same and at - us < GAP_S * 1_000_000 else 0.0
            begun, place, us = True, here, at
            if here is not None and here == destination and metres < ARRIVED_M:
                out.append((key[0], "arrived", here, event_id, seq, None, None, None))
            if here is None or not eligible or metres >= NEAR_M:
                continue
            visits, intended, dwell = self.totals.getValue((here,)) if self.totals.containsKey((here,)) else (0, 0, 0.0)
            meant = here in (destination, scheduled) or any(here in s for s in searches)
            visits, intended, dwell = visits + (not same), intended + (not same and meant), dwell + minutes
            self.totals.updateValue((here,), (int(visits), int(intended), float(dwell)))
            out.append((key[0], "visit", here, event_id, seq, int(visits), int(intended), float(dwell)))
        if due:
            self.last.update((begun, place, us, seq, searches, expires))
            if seq and not left:
                self.handle.registerTimer(expires)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(x[0] for x in left) // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")]).astype({"visits": "Int64", "intended": "Int64"})

    def close(self) -> None:
        pass


def track(pings: DataFrame, places: DataFrame, late: str = "10 minutes", ttl_ms: int = 48 * 3600 * 1000, reach: float = REACH_M) -> DataFrame:
    """``VisitTracker`` over a stream of pings. It needs the RocksDB state store, which the session's settings name."""
    rows = snapped(pings, places, reach).withWatermark("ts", late)
    return rows.groupBy("user_id").transformWithStateInPandas(VisitTracker(ttl_ms), VisitTracker.OUTPUT, "Update", "EventTime")
