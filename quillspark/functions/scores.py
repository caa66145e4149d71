"""Scalar scores: geography, time of day, visits, routing tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two points."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))), F.lit(360.0))


def compass(degrees: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), (F.floor((degrees + 22.5) / 45) % 8 + 1).cast("int"))


def detour(ab: Column, bc: Column, ac: Column) -> Column:
    """18 to 0 over the first 60 m of detour, 5 to 0 over the next 60, then -5."""
    d = F.greatest(F.lit(0.0), ab + bc - ac)
    return F.when(d <= 60, 18 * (1 - d / 60)).when(d <= 120, 5 * (1 - (d - 60) / 60)).otherwise(F.lit(-5.0))


def clip_score(raw: Column, full: float = 60.0) -> Column:
    """raw as a part of full, in 0 to 100, one decimal, half to even."""
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw / full * 100)), 1)


def dwell_factor(minutes: Column) -> Column:
    return 1 - F.exp(-0.15 * minutes)


def visit_weight(visits: Column, dwell: Column, intended: Column) -> Column:
    share = F.when(visits > 0, intended / visits).otherwise(F.lit(0.0))
    return F.round(0.5 * dwell_factor(dwell) + 0.3 * share + 0.2 * F.least(F.lit(1.0), F.log1p(visits) / F.log(F.lit(31.0))), 3)


def history_boost(weight: Column, most: float = 8.0) -> Column:
    """A logistic curve of the weight, scaled to run from 0 at 0 to ``most`` at 1."""
    s = lambda x: 1 / (1 + F.exp(-10 * (x - 0.5)))
    lo, hi = s(F.lit(0.0)), s(F.lit(1.0))
    return F.round(most * (s(weight) - lo) / (hi - lo), 3)


def minutes_of_day(hhmm: Column) -> Column:
    """Minutes since midnight of HH:MM; null if it is none."""
    h, m = F.try_element_at(F.split(hhmm, ":"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(hhmm, ":"), F.lit(2)).try_cast("int")
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m)


def open_now(now: Column, opens: Column, closes: Column) -> Column:
    """Open through midnight if it closes before it opens; open if either is null."""
    return F.when(opens.isNull() | closes.isNull(), True).when(opens <= closes, now.between(opens, closes)).otherwise((now >= opens) | (now <= closes))


def minutes_to_close(now: Column, closes: Column) -> Column:
    """Null for places that close at 23:59."""
    return F.when(closes != 23 * 60 + 59, F.pmod(closes - now, F.lit(1440)))


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def rating_weight(stars: Column) -> Column:
    return F.when(stars == 5, 2.0).when(stars == 4, 1.5).when(stars == 3, 1.0).when(stars == 2, 0.4).otherwise(F.lit(0.1))


def crowd_label(level: Column) -> Column:
    return F.when(level >= 0.85, "packed").when(level >= 0.6, "busy").when(level >= 0.35, "moderate").otherwise(F.lit("quiet"))
