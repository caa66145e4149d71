"""What is around a position: clusters to explore, calmer places; rankings that try something else now and then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scores import haversine

from .graphs import cut

#: Crowd from which a place is busy, and under which another is calm; metres to a calmer place.
BUSY, CALM, CALM_M = 0.8, 0.65, 400.0
_DEGREE_M = 111_195.0


def within(points: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """Points (lat, lon and more) with each place (place, place_lat, place_lon and more) at most so far off, and ``metres``.

    Places stand in their grid cell and the eight around it, cells being as wide as the distance (up to 60
    degrees of latitude), so near ones meet by an equal join.
    """
    side = metres / _DEGREE_M
    cell = lambda c, width: F.floor(F.col(c) / width)
    around = lambda c, width: F.explode(F.sequence(cell(c, width) - 1, cell(c, width) + 1))
    wide = places.filter("place_lat IS NOT NULL AND place_lon IS NOT NULL").withColumn("_y", around("place_lat", side)).withColumn("_x", around("place_lon", 2 * side))
    near = points.withColumn("_y", cell("lat", side)).withColumn("_x", cell("lon", 2 * side)).join(wide, ["_y", "_x"]).drop("_y", "_x")
    far = F.round(haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 3)
    return near.withColumn("metres", far).filter(F.col("metres") <= metres)


def explore_clusters(points: DataFrame, places: DataFrame, pid: str, radius: float = 120.0) -> DataFrame:
    """(pid, cluster, votes, near): the cluster of most places within the radius of a point, the smaller among equals, and all places there.

    ``places`` is (place, place_lat, place_lon, cluster); a place without a cluster is near but has no vote.
    A point without a vote has no row. Points at one spot get one answer, and places of a cluster at one spot
    are counted before they meet.
    """
    spots = points.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    counted = places.groupBy("place_lat", "place_lon", "cluster").agg(F.count("*").alias("here"))
    near = within(spots, counted, radius)
    votes = near.groupBy("lat", "lon", "cluster").agg(F.sum("here").alias("n"))
    best = F.min_by(F.struct("cluster", "n"), F.when(F.col("cluster").isNotNull(), F.struct(-F.col("n"), F.col("cluster"))))
    rows = votes.groupBy("lat", "lon").agg(best.alias("best"), F.sum("n").alias("near")).filter("best IS NOT NULL")
    return points.select(pid, "lat", "lon").join(rows, ["lat", "lon"]).select(pid, "best.cluster", F.col("best.n").alias("votes"), "near")


def crowd_now(predicted: Column, live: Column) -> Column:
    """A forecast, with six tenths of a live report if there is one."""
    return F.when(live.isNull(), predicted).otherwise(F.round(0.4 * predicted + 0.6 * live, 2))


def nearness(metres: Column, near: float = 80.0, far: float = 1000.0) -> Column:
    """Points for a distance: full when near, falling to nothing at a kilometre, a malus when too far."""
    return (
        F.when(metres > far, -20.0)
        .when(metres <= near, 22.0)
        .when(metres <= 200, 18.0 - metres / 200 * 4)
        .when(metres <= 500, 12.0 - (metres - 200) / 300 * 6)
        .otherwise(F.greatest(F.lit(0.0), 8.0 - (metres - 500) / 500 * 8))
    )


def calmer_places(requests: DataFrame, places: DataFrame, services: DataFrame, names: DataFrame, similar: DataFrame, rid: str) -> DataFrame:
    """(rid, place, crowd, metres, score): for each request (rid, busy, lat, lon) of a busy place the most similar open, calm place within 400 m.

    ``places`` is (place, place_lat, place_lon, crowd, is_open). Likeness is 20 a shared category of
    ``services`` (place, category), 5 a shared alias of ``names`` (place, alias), 25 if ``similar`` (a, b)
    pairs them, and half of the points for the distance; ties go to the smaller place. A request whose place
    isn't busy, or with no such place around, has no row.

    Places with the same categories and aliases are alike, so from a spot only two of each kind count, the two
    of most points for the distance (one may be the busy place itself); a spot and a kind of busy place have
    one answer for all requests, again of two places. Places that ``similar`` pairs with the busy one are
    looked at by themselves, and the better of both counts.
    """
    busy = places.filter(F.col("crowd") >= BUSY).select(F.col("place").alias("busy"))
    asked = requests.select(rid, "busy", "lat", "lon").join(busy, "busy", "left_semi")
    calm = places.filter((F.col("crowd") < CALM) & F.coalesce("is_open", F.lit(True))).select("place", "place_lat", "place_lon", "crowd")
    kinds = cut(_kinds(places.select("place"), services, names))
    spots = asked.select("lat", "lon").filter("lat IS NOT NULL AND lon IS NOT NULL").distinct()
    points = F.round(0.5 * nearness(F.col("metres")), 6)
    stand = Window.partitionBy("place_lat", "place_lon", "kind").orderBy("place")
    firsts = calm.join(kinds, "place").withColumn("turn", F.row_number().over(stand)).filter("turn <= 2").drop("turn")
    nearest = Window.partitionBy("lat", "lon", "kind").orderBy(F.desc("near"), "place")
    by_kind = within(spots, firsts, CALM_M).withColumn("near", points).withColumn("turn", F.row_number().over(nearest)).filter("turn <= 2")
    by_kind = cut(by_kind.select("lat", "lon", "kind", "place", "crowd", "metres"))
    alike = cut(_likeness(kinds.join(calm.select("place"), "place", "left_semi").select("kind", "categories", "aliases").distinct(), kinds.join(busy.withColumnRenamed("busy", "place"), "place", "left_semi").select("kind", "categories", "aliases").distinct()))
    asked = cut(asked.join(kinds.select(F.col("place").alias("busy"), F.col("kind").alias("wanted")), "busy"))
    score = F.round(F.coalesce("p", F.lit(0.0)) + 0.5 * nearness(F.col("metres")), 6)
    rows = asked.select("lat", "lon", "wanted").distinct().join(by_kind, ["lat", "lon"]).join(alike, ["wanted", "kind"], "left").withColumn("score", score)
    better = F.struct((-F.col("score")).alias("o"), "place", "crowd", "metres", "score")
    two = rows.groupBy("lat", "lon", "wanted").agg(F.min(better).alias("a"))
    second = rows.join(two.select("lat", "lon", "wanted", F.col("a.place").alias("first")), ["lat", "lon", "wanted"]).filter("place <> first").groupBy("lat", "lon", "wanted").agg(F.min(better).alias("b"))
    two = two.join(second, ["lat", "lon", "wanted"], "left")
    one = asked.join(two, ["lat", "lon", "wanted"]).select(rid, F.when(F.col("a.place") != F.col("busy"), F.col("a")).otherwise(F.col("b")).alias("x")).filter("x IS NOT NULL")
    both = similar.select("a", "b").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    pairs = asked.join(both.toDF("busy", "place"), "busy").join(calm, "place").join(kinds.select("place", "kind"), "place")
    pairs = pairs.withColumn("metres", F.round(haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 3)).filter(F.col("metres") <= CALM_M)
    pairs = pairs.join(alike, ["wanted", "kind"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)) + 25).withColumn("score", score)
    every = one.unionByName(pairs.select(rid, better.alias("x")))
    return every.groupBy(rid).agg(F.min("x").alias("x")).select(rid, "x.place", "x.crowd", "x.metres", "x.score")


def _kinds(places: DataFrame, services: DataFrame, names: DataFrame) -> DataFrame:
    """(place, kind, categories, aliases): the sorted categories and aliases of each place; kinds alike have one name."""
    all_of = lambda of, by, name: of.groupBy("place").agg(F.array_sort(F.collect_set(by)).alias(name))
    none = lambda of, by: F.coalesce(F.col(by), F.array().cast(of))
    a, b = all_of(services, "category", "categories"), all_of(names, "alias", "aliases")
    types = {**dict(a.dtypes), **dict(b.dtypes)}
    rows = places.join(a, "place", "left").join(b, "place", "left").select("place", *(none(types[c], c).alias(c) for c in ("categories", "aliases")))
    return rows.withColumn("kind", F.to_json(F.struct("categories", "aliases")))


def _likeness(calm: DataFrame, busy: DataFrame) -> DataFrame:
    """(wanted, kind, p): 20 a shared category and 5 a shared alias of a busy and a calm kind."""
    rows = None
    for by, points in (("categories", 20.0), ("aliases", 5.0)):
        one = lambda df, name: df.select(F.col("kind").alias(name), F.explode(by).alias("v"))  # noqa: B023, E731
        met = one(busy, "wanted").join(one(calm, "kind"), "v").groupBy("wanted", "kind").agg((points * F.count("*")).alias("p"))
        rows = met if rows is None else rows.unionByName(met)
    return rows.groupBy("wanted", "kind").agg(F.sum("p").alias("p"))


def uniform(*parts: Column | str) -> Column:
    """A number between 0 and 1, neither included, from the MD5 of some values: the same in every run."""
    digits = F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def gumbel_rank(candidates: DataFrame, user: str, item: str, seed: int = 0, temperature: float = 0.6, pool: int | None = None) -> DataFrame:
    """Candidates (user, item, score) with ``place``: the ``pool`` best of each user (all, without one) dealt anew, the rest behind in order of score.

    A score over the temperature plus Gumbel noise ranks the pool, so what scores higher more often stands
    higher. The noise is drawn from seed, user and item: a rerun deals alike.
    """
    by_score = Window.partitionBy(user).orderBy(F.desc("score"), item)
    noise = -F.log(-F.log(uniform(F.lit(seed), user, item)))
    rows = candidates.withColumn("_turn", F.row_number().over(by_score))
    pooled = F.lit(True) if pool is None else F.col("_turn") <= pool
    rows = rows.withColumn("_key", F.when(pooled, F.col("score") / max(temperature, 1e-6) + noise))
    again = Window.partitionBy(user).orderBy(F.desc_nulls_last("_key"), "_turn")
    return rows.withColumn("place", F.row_number().over(again)).drop("_turn", "_key")


def epsilon_move(ranked: DataFrame, user: str, seed: int = 0, epsilon: float = 0.15, keep: int = 3) -> DataFrame:
    """Ranked rows (user, place from 1) with ``place`` anew: for some users, chosen with chance ``epsilon``, one row from behind the first ``keep`` stands right behind them.

    Both draws are from seed and user, so a rerun moves the same rows. Users of ``keep`` rows or fewer keep theirs.
    """
    n = F.count("*").over(Window.partitionBy(user))
    moves = (uniform(F.lit(seed), F.lit("move"), user) <= epsilon) & (n > keep)
    chosen = F.when(moves, keep + 1 + F.floor(uniform(F.lit(seed), F.lit("which"), user) * (n - keep)))
    rows = ranked.withColumn("_chosen", chosen)
    place = F.when(F.col("place") == F.col("_chosen"), keep + 1).when((F.col("place") > keep) & (F.col("place") < F.col("_chosen")), F.col("place") + 1).otherwise(F.col("place"))
    return rows.withColumn("place", place.cast("int")).drop("_chosen")
