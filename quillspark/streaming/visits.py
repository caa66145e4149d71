"""Structured Streaming twins of the state operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_S = 300


def visit_updates(pings: DataFrame, late: str = "10 minutes", ttl_ms: int = 48 * 3600 * 1000) -> DataFrame:
    """(user_id, place, visits, dwell): totals of each user's places after each batch that has pings of the user.

    State holds the last place and time and the totals by place; a user whom the watermark finds without pings
    for ``ttl_ms`` is forgotten, and pings behind the watermark are dropped. Pings of a batch are taken in order
    of time. Rows: user_id long, ts timestamp, place string.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_place, last_ts, places, visits, dwell = state.get if state.exists else (None, None, [], [], [])
        totals = {p: [v, d] for p, v, d in zip(places, visits, dwell)}
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for place, ts in zip(rows["place"], rows["ts"].astype("datetime64[us]").astype("int64")):
            total = totals.setdefault(place, [0, 0.0])
            if place == last_place:
                if ts - last_ts < GAP_S * 1_000_000:
                    total[1] += (ts - last_ts) / 60e6
            else:
                total[0] += 1
            last_place, last_ts = place, int(ts)
        state.update((last_place, last_ts, list(totals), [v for v, _ in totals.values()], [d for _, d in totals.values()]))
        state.setTimeoutTimestamp(last_ts // 1000 + ttl_ms)
        yield pd.DataFrame({"user_id": key[0], "place": list(totals), "visits": [v for v, _ in totals.values()], "dwell": [d for _, d in totals.values()]})

    return pings.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(
        step,
        "user_id long, place string, visits long, dwell double",
        "last_place string, last_ts long, places array<string>, visits array<long>, dwell array<double>",
        "update",
        GroupStateTimeout.EventTimeTimeout,
    )


def session_counts(events: DataFrame, late: str = "10 minutes", gap: str = "5 minutes") -> DataFrame:
    """(user_id, start, n) of closed sessions; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def window_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """(event_type, start, n) over sliding windows."""
    return events.withWatermark("ts", late).groupBy("event_type", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def upsert_latest(batch: DataFrame, target: DataFrame | None, keys: list[str], order: str) -> DataFrame:
    """The target's rows and a batch's, the latest of each key; for foreachBatch, written to a new version of the table."""
    rows = batch if target is None else target.unionByName(batch)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
