"""Candidate places of requests from eight sources, each under its best one, and what comes without a history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scores import detour, haversine

from .explore import nearness, within
from .fusion import merged_candidates
from .graphs import cut, shortest_routes
from .retrieval import tfidf_scores, top_k

#: Metres: near; near enough for a detour; how far context and history reach, in times of near; at a place.
NEAR_M, DETOUR_M, CONTEXT_X, HISTORY_X, HERE_M, SKIP_M = 350.0, 120.0, 1.5, 2.0, 50.0, 30.0
#: Sources in order: of equal scores the earliest counts.
SOURCES = ("time_morning", "time_context", "personal_history", "route_context", "route_neighbor", "ai_context", "nearby_context")
#: Least points of a place by context; what a place never visited gains.
LEAST, NOVEL = 12.0, 4.0


def routes_to(requests: DataFrame, nearest: DataFrame, edges: DataFrame) -> DataFrame:
    """(rid, path): the cheapest way from each request's nearest place (rid, nearest) to its destination, if they differ.

    Ways are worked out once for each place that a request starts from, over the graph of ways (src, dst,
    weight), which is small beside the requests.
    """
    asked = requests.filter("destination IS NOT NULL").select("rid", "destination").join(nearest.select("rid", "nearest"), "rid").filter("nearest <> destination")
    ways = shortest_routes(edges, asked.select(F.col("nearest").alias("node")).distinct())
    return asked.join(ways.select(F.col("start").alias("nearest"), F.col("node").alias("destination"), "path"), ["nearest", "destination"]).select("rid", "path")


def candidates(
    requests: DataFrame,
    places: DataFrame,
    edges: DataFrame,
    visits: DataFrame,
    similar: DataFrame,
    context: Callable[[DataFrame], DataFrame],
    boosts: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """(rid, place, raw, source): the open places that a request may be shown, each with its best source.

    ``requests`` is (rid, user, lat, lon, minute, destination), ``places`` (place, place_lat, place_lon, crowd,
    is_open, food, parking), ``edges`` (src, dst, weight) the ways in both directions, ``visits`` (user, place,
    visits), ``similar`` (user, place, score) what users alike go to. ``context`` and ``boosts`` take pairs
    (rid, user, place, minute, metres) and give (rid, place, points), as the rule engine does.

    Sources: food near in the morning; parking before the way home and food near at meal times; what the user
    has visited; places on the way to the destination, and those beside it; places that context speaks for;
    the place where the user stands. To each score come the points of ``boosts`` and, for a place never
    visited, ``NOVEL``. The place where the user stands (within ``SKIP_M``) only comes by history or as
    itself. What users alike go to then raises a candidate, or comes in by itself.
    """
    spots = places.select("place", "place_lat", "place_lon", "crowd", F.coalesce("is_open", F.lit(True)).alias("is_open"), F.coalesce("food", F.lit(False)).alias("food"), F.coalesce("parking", F.lit(False)).alias("parking"))
    asked = requests.select("rid", "user", "lat", "lon", "minute", "destination")
    near = cut(within(asked, spots, HISTORY_X * NEAR_M))
    first = near.groupBy("rid").agg(F.min(F.struct("metres", "place")).alias("x"))
    nearest = cut(first.select("rid", F.col("x.place").alias("nearest"), F.col("x.metres").alias("nearest_m")))
    at = lambda a, b: F.col("minute").between(a, b)
    ends = spots.select(F.col("place").alias("destination"), F.col("place_lat").alias("to_lat"), F.col("place_lon").alias("to_lon"))
    aim = asked.select("rid", "lat", "lon", "destination").join(ends, "destination").select("rid", F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), "to_lat", "to_lon")
    go = lambda a, b, c, d: haversine(F.col(a), F.col(b), F.col(c), F.col(d))
    aligned = detour(go("from_lat", "from_lon", "place_lat", "place_lon"), go("place_lat", "place_lon", "to_lat", "to_lon"), go("from_lat", "from_lon", "to_lat", "to_lon"))
    metres = F.round(go("from_lat", "from_lon", "place_lat", "place_lon"), 3)

    def source(rows: DataFrame, name: str, raw: Column) -> DataFrame:
        return rows.select("rid", "place", raw.cast("double").alias("raw"), F.lit(SOURCES.index(name)).alias("turn"))

    close = near.filter(F.col("metres") < NEAR_M)
    parts = [
        source(close.filter(at(300, 540) & F.col("food")), "time_morning", F.lit(36)),
        source(near.filter(at(990, 1110) & F.col("parking")), "time_context", F.lit(42)),
        source(close.filter((at(660, 780) | at(1020, 1110)) & F.col("food")), "time_context", F.lit(38)),
    ]
    known = near.join(visits.select("user", "place", "visits"), ["user", "place"]).filter(F.col("metres") < HISTORY_X * NEAR_M)
    parts.append(source(known, "personal_history", 25 + F.least(F.lit(10.0), 4 * F.log1p("visits"))))
    ways = cut(routes_to(asked, nearest, edges))
    on = ways.select("rid", F.explode(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0)))).alias("place"))
    on = on.join(spots, "place").join(aim, "rid").withColumn("metres", metres)
    crowded = F.when(F.col("crowd") >= 0.85, -8).otherwise(4)
    parts.append(source(on, "route_context", 30 + F.when(F.col("metres") < DETOUR_M, 25).otherwise(12) + aligned + crowded))
    beside = ways.select("rid", "path", F.explode("path").alias("src")).join(edges.select("src", F.col("dst").alias("place")).distinct(), "src").filter(~F.array_contains("path", F.col("place")))
    beside = beside.select("rid", "place").distinct().join(spots, "place").join(aim, "rid").withColumn("metres", metres).filter(F.col("metres") <= NEAR_M)
    parts.append(source(beside, "route_neighbor", 22 + aligned))
    around = near.filter(F.col("metres") <= CONTEXT_X * NEAR_M)
    pairs = around.select("rid", "user", "place", "minute", "metres")
    told = around.join(context(pairs).select("rid", "place", "points"), ["rid", "place"], "left").join(aim, "rid", "left")
    step = F.when(F.col("metres") < 50, 12).when(F.col("metres") < 150, 6).otherwise(0)
    calm = F.when(F.col("crowd") <= 0.35, 5).when(F.col("crowd") >= 0.85, -6).otherwise(0)
    told = told.withColumn("raw", F.coalesce("points", F.lit(0.0)) + step + F.coalesce(aligned, F.lit(0.0)) + calm).filter(F.col("raw") >= LEAST)
    parts.append(source(told, "ai_context", F.col("raw")))
    here = nearest.filter(F.col("nearest_m") < HERE_M).select("rid", F.col("nearest").alias("place"))
    parts.append(source(here, "nearby_context", F.lit(28)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.join(nearest, "rid")
    standing = (F.col("place") == F.col("nearest")) & (F.col("nearest_m") < SKIP_M)
    rows = rows.filter(~standing | F.col("turn").isin(SOURCES.index("nearby_context"), SOURCES.index("personal_history")))
    rows = rows.join(spots.filter("is_open").select("place"), "place", "left_semi")
    best = rows.groupBy("rid", "place").agg(F.max(F.struct("raw", -F.col("turn"))).alias("x")).select("rid", "place", F.col("x.raw").alias("raw"), (-F.col("x.col2")).alias("turn"))
    best = best.join(asked.select("rid", "user", "lat", "lon", "minute"), "rid").join(spots.select("place", "place_lat", "place_lon"), "place")
    best = cut(best.withColumn("metres", F.round(haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 3)).select("rid", "user", "place", "minute", "metres", "raw", "turn"))
    gained = best.join(boosts(best.select("rid", "user", "place", "minute", "metres")).select("rid", "place", "points"), ["rid", "place"], "left")
    gained = gained.join(visits.select("user", "place", F.lit(True).alias("seen")).distinct(), ["user", "place"], "left")
    raw = F.col("raw") + F.coalesce("points", F.lit(0.0)) + F.when(F.col("seen"), 0.0).otherwise(NOVEL)
    gained = gained.select("rid", F.col("place").alias("item"), raw.alias("raw"), "turn")
    like = asked.select("rid", "user").join(similar, "user").join(spots.filter("is_open").select("place"), "place", "left_semi")
    like = like.join(nearest.select("rid", F.col("nearest").alias("place")), ["rid", "place"], "left_anti").select("rid", F.col("place").alias("item"), "score")
    out = merged_candidates(gained.select("rid", "item", "raw"), like, "rid").join(gained.select("rid", "item", "turn"), ["rid", "item"], "left")
    name = F.element_at(F.array(*map(F.lit, (*SOURCES, "collaborative"))), F.coalesce("turn", F.lit(len(SOURCES))) + 1)
    return out.select("rid", F.col("item").alias("place"), "raw", name.alias("source"))


def with_cold_start(found: DataFrame, interests: DataFrame, items: DataFrame, user: str, item: str, k: int = 8, least: float = 0.05) -> DataFrame:
    """(user, item, score, rank, source): recommendations (user, item, score, rank), and for users without any the items nearest to their interests.

    ``interests`` is (user, text), ``items`` (item, text). Likeness is the cosine of TF-IDF vectors, of
    ``least`` or more. Only users without a recommendation are compared. A user with neither has no row.
    A text that many users share is compared once. ``found`` is written, as it says who has one too.
    """
    found = cut(found.select(user, item, "score", "rank"))
    have = found.select(user).distinct()
    cold = interests.join(have, user, "left_anti")
    texts = cold.groupBy("text").agg(F.min(user).alias("_asks"))
    hits = top_k(tfidf_scores(items, texts, item, "_asks").filter(F.col("score") >= least), "_asks", item, k)
    like = cold.join(texts, "text").select(user, "_asks").join(hits, "_asks")
    return found.select(user, item, "score", "rank", F.lit("similar").alias("source")).unionByName(like.select(user, item, "score", "rank", F.lit("interests").alias("source")))


def context_scores(pairs: DataFrame, points: Callable[[DataFrame], DataFrame], far: float = 1000.0) -> DataFrame:
    """(rid, place, total, filtered) of pairs (rid, place, minute, metres, crowd, is_open): what their context is worth.

    The points of ``points`` (a function of the pairs, as in ``candidates``), of the distance, and of the crowd.
    A closed place is filtered as 'closed', one further off than ``far`` as 'out_of_radius'.
    """
    told = pairs.join(points(pairs).select("rid", "place", "points"), ["rid", "place"], "left")
    crowded = F.when(F.col("crowd") >= 0.85, -15).when(F.col("crowd") <= 0.35, 5).otherwise(0)
    total = F.coalesce("points", F.lit(0.0)) + nearness(F.col("metres"), far=far) + crowded
    filtered = F.when(~F.coalesce("is_open", F.lit(True)), "closed").when(F.col("metres") > far, "out_of_radius")
    return told.select("rid", "place", total.alias("total"), filtered.alias("filtered"))


def enhanced(found: DataFrame, members: DataFrame, scored: DataFrame, limit: int = 8, share: float = 0.35, explore: float = 30.0) -> DataFrame:
    """(rid, place, combined, source, rank): the ``limit`` best of candidates (rid, place, raw, source) with ``share`` of their context's score, and members of the cluster to explore.

    ``scored`` is ``context_scores`` of all of them; what it filters goes. A member (rid, place) that is no
    candidate comes in with ``explore`` over its context's score. Ties go to the smaller place.
    """
    kept = scored.filter("filtered IS NULL").select("rid", "place", "total")
    rows = found.join(kept, ["rid", "place"]).select("rid", "place", F.round(F.col("raw") + share * F.col("total"), 9).alias("score"), "source")
    more = members.select("rid", "place").distinct().join(found.select("rid", "place"), ["rid", "place"], "left_anti").join(kept, ["rid", "place"])
    rows = rows.unionByName(more.select("rid", "place", F.round(F.col("total") + explore, 9).alias("score"), F.lit("explore_cluster").alias("source")))
    return top_k(rows, "rid", "place", limit).select("rid", "place", F.col("score").alias("combined"), "source", "rank")
