"""Candidates from eight sources for customers on the way, and recommendations for those without a history."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.scores import haversine
from quillspark.operators import candidates as D
from quillspark.operators import explore as X
from quillspark.operators import recommend as C
from quillspark.operators.graphs import cut
from quillspark.operators.retrieval import top_k
from quillspark.operators.rules import evaluate, rule, tables, when

from .recommend_queries import SIM_CTE, _most_bought, _visits
from .register import query
from .rule_queries import is_

#: What speaks for a place by the time of the request, and what a customer's trade gains by its kind.
CONTEXT = [
    rule("morning", 1, 9, None, [when("minute", "between", low=300, high=720)], is_("kind", "k0", "k2")),
    rule("evening", 2, 8, None, [when("minute", "above", low=1000)], is_("kind", "k1")),
    rule("shop", 3, 7, None, is_("kind", "k3")),
    rule("far", 4, -3, None, [when("metres", "above", low=400)]),
]
BOOSTS = [
    rule("builder", 1, 5, "trade", is_("kind", "k1", "k2"), rule_set="BUILDING"),
    rule("maker", 1, 9, "trade", is_("kind", "k0"), rule_set="MACHINERY"),
    rule("house", 1, -4, None, is_("kind", "k3"), rule_set="HOUSEHOLD"),
    rule("room", 2, 0, None, per="size", factor=0.25, most=12.0),
]

WORLD_CTE = """
pl AS MATERIALIZED (SELECT n_nationkey AS place, 10 + n_nationkey % 5 * 0.0015::DOUBLE AS plat, 106 + n_nationkey // 5 * 0.0015::DOUBLE AS plon, n_nationkey % 11 / 10.0::DOUBLE AS crowd, n_nationkey <> 13 AS is_open, n_nationkey % 4 = 1 AS food, n_nationkey = 20 AS parking, 'k' || n_nationkey % 4 AS kind FROM nation),
rq AS MATERIALIZED (SELECT c_custkey AS rid, c_mktsegment AS seg, 10 + c_custkey % 101 * 0.00006::DOUBLE AS lat, 106 + c_custkey % 89 * 0.00007::DOUBLE AS lon, c_custkey * 37 % 1440 AS minute, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 25 END AS dest FROM customer),
eg AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0 + n_nationkey % 4 AS weight FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 5.0 + n_nationkey % 3 FROM nation WHERE n_nationkey % 3 <> 0),
e AS MATERIALIZED (SELECT src, dst, weight::DOUBLE AS weight FROM eg UNION ALL SELECT dst, src, weight::DOUBLE FROM eg),
wy AS (SELECT n_nationkey AS start, n_nationkey AS node, 0.0::DOUBLE AS cost, [n_nationkey] AS path FROM nation UNION ALL SELECT w.start, e.dst, w.cost + e.weight, list_append(w.path, e.dst) FROM wy w JOIN e ON e.src = w.node WHERE len(w.path) < 9 AND NOT list_contains(w.path, e.dst)),
bw AS MATERIALIZED (SELECT start, node, path FROM wy QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY cost, path) = 1),
vs AS MATERIALIZED (SELECT o_custkey AS usr, o_orderkey % 25 AS place, count(*) AS n FROM orders GROUP BY ALL),
sf AS (SELECT place, count(*)::DOUBLE AS f FROM vs GROUP BY place),
sm0 AS (SELECT a.place AS a, b.place AS b, count(*) AS s FROM vs a JOIN vs b ON a.usr = b.usr AND a.place < b.place GROUP BY ALL),
sm AS (SELECT a, b, round(s / (sqrt(fa.f * fb.f) + 1e-8), 6) AS sim FROM sm0 JOIN sf fa ON fa.place = a JOIN sf fb ON fb.place = b),
sd AS (SELECT usr, place FROM vs QUALIFY row_number() OVER (PARTITION BY usr ORDER BY n DESC, place) <= 6),
s2 AS (SELECT a, b, sim FROM sm WHERE sim >= 0.01 UNION ALL SELECT b, a, sim FROM sm WHERE sim >= 0.01),
cf0 AS (SELECT usr, b AS place, round(sum(sim), 6) AS score FROM sd JOIN s2 ON sd.place = a WHERE NOT EXISTS (SELECT 1 FROM sd z WHERE z.usr = sd.usr AND z.place = s2.b) GROUP BY ALL),
cf AS MATERIALIZED (SELECT usr, place, score FROM cf0 QUALIFY row_number() OVER (PARTITION BY usr ORDER BY score DESC, place) <= 5),
hv AS MATERIALIZED (SELECT *, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) AS m0 FROM (SELECT rid, place, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2) AS h FROM rq, pl)),
pp AS (SELECT a.place AS p, b.place AS d, 2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)) AS m FROM (SELECT a.place, b.place AS q, pow(sin(radians(b.plat - a.plat) / 2), 2) + cos(radians(a.plat)) * cos(radians(b.plat)) * pow(sin(radians(b.plon - a.plon) / 2), 2) AS h FROM pl a, pl b) a JOIN (SELECT place FROM pl) b ON a.q = b.place),
dt AS MATERIALIZED (SELECT h.rid, h.place, round(h.m0, 3) AS metres, r.minute, r.seg, crowd, is_open, food, parking, kind, greatest(0.0, h.m0 + pp.m - t.m0) AS extra FROM hv h JOIN rq r USING (rid) JOIN pl USING (place) LEFT JOIN pp ON pp.p = h.place AND pp.d = r.dest LEFT JOIN hv t ON t.rid = h.rid AND t.place = r.dest),
al AS MATERIALIZED (SELECT *, CASE WHEN extra IS NULL THEN NULL WHEN extra <= 60 THEN 18 * (1 - extra / 60) WHEN extra <= 120 THEN 5 * (1 - (extra - 60) / 60) ELSE -5.0 END AS align FROM dt),
ne AS MATERIALIZED (SELECT rid, min({'m': metres, 'p': place}) AS x FROM dt WHERE metres <= 700 GROUP BY rid),
rt AS MATERIALIZED (SELECT rid, path FROM rq JOIN ne USING (rid) JOIN bw ON bw.start = ne.x.p AND bw.node = rq.dest WHERE ne.x.p <> rq.dest),
src AS (
  SELECT rid, place, 36.0::DOUBLE AS raw, 0 AS turn FROM al WHERE minute BETWEEN 300 AND 540 AND food AND metres < 350
  UNION ALL SELECT rid, place, 42.0, 1 FROM al WHERE minute BETWEEN 990 AND 1110 AND parking AND metres <= 700
  UNION ALL SELECT rid, place, 38.0, 1 FROM al WHERE (minute BETWEEN 660 AND 780 OR minute BETWEEN 1020 AND 1110) AND food AND metres < 350
  UNION ALL SELECT rid, al.place, 25 + least(10.0, 4 * ln(1 + n)), 2 FROM al JOIN vs ON vs.usr = rid AND vs.place = al.place WHERE metres < 700
  UNION ALL SELECT al.rid, al.place, 30 + CASE WHEN metres < 120 THEN 25 ELSE 12 END + align + CASE WHEN crowd >= 0.85 THEN -8 ELSE 4 END, 3 FROM al JOIN rt ON rt.rid = al.rid AND list_contains(path[2:-2], al.place)
  UNION ALL SELECT al.rid, al.place, 22 + align, 4 FROM al JOIN rt ON rt.rid = al.rid WHERE metres <= 350 AND NOT list_contains(path, al.place) AND EXISTS (SELECT 1 FROM e WHERE e.dst = al.place AND list_contains(rt.path, e.src))
  UNION ALL SELECT rid, place, raw, 5 FROM (SELECT rid, place, CASE WHEN minute BETWEEN 300 AND 720 AND kind IN ('k0', 'k2') THEN 9 ELSE 0 END + CASE WHEN minute > 1000 AND kind = 'k1' THEN 8 ELSE 0 END + CASE WHEN kind = 'k3' THEN 7 ELSE 0 END + CASE WHEN metres > 400 THEN -3 ELSE 0 END
    + CASE WHEN metres < 50 THEN 12 WHEN metres < 150 THEN 6 ELSE 0 END + coalesce(align, 0) + CASE WHEN crowd <= 0.35 THEN 5 WHEN crowd >= 0.85 THEN -6 ELSE 0 END AS raw FROM al WHERE metres <= 525) WHERE raw >= 12
  UNION ALL SELECT rid, x.p, 28.0, 6 FROM ne WHERE x.m < 50),
bs AS (SELECT s.* FROM src s JOIN ne USING (rid) JOIN pl USING (place) WHERE is_open AND (NOT (s.place = x.p AND x.m < 30) OR turn IN (2, 6)) QUALIFY row_number() OVER (PARTITION BY rid, place ORDER BY raw DESC, turn) = 1),
gn AS (SELECT bs.rid, bs.place, turn, raw + CASE WHEN seg = 'BUILDING' AND kind IN ('k1', 'k2') THEN 5 WHEN seg = 'MACHINERY' AND kind = 'k0' THEN 9 WHEN seg = 'HOUSEHOLD' AND kind = 'k3' THEN -4 ELSE 0 END + 0.25 * least(place, 12) + CASE WHEN n IS NULL THEN 4 ELSE 0 END AS raw
  FROM bs JOIN dt USING (rid, place) LEFT JOIN vs ON vs.usr = bs.rid AND vs.place = bs.place),
lk AS (SELECT usr AS rid, cf.place, score FROM cf JOIN pl USING (place) JOIN rq ON rq.rid = usr LEFT JOIN ne ON ne.rid = usr WHERE is_open AND (ne.x.p IS NULL OR ne.x.p <> cf.place))"""


@query("customer", "orders", "nation", sql=f"""WITH RECURSIVE {WORLD_CTE}
SELECT coalesce(gn.rid, lk.rid) AS rid, coalesce(gn.place, lk.place) AS place, round(CASE WHEN raw IS NULL THEN least(100 * score, 12) + 8 ELSE raw + coalesce(least(100 * score, 12), 0) END, 6)::DOUBLE AS raw,
  ['time_morning', 'time_context', 'personal_history', 'route_context', 'route_neighbor', 'ai_context', 'nearby_context', 'collaborative'][coalesce(turn, 7) + 1] AS source FROM gn FULL JOIN lk ON gn.rid = lk.rid AND gn.place = lk.place""")
def c6_candidates_whole(customer, orders, nation):
    """Every customer's candidates from time, history, way, context, place and users alike, each under its best source."""
    return _found(customer, orders, nation)


def _requests(customer):
    k = F.col("c_custkey")
    return customer.select(k.alias("rid"), k.alias("user"), (10 + k % 101 * 0.00006).alias("lat"), (106 + k % 89 * 0.00007).alias("lon"), (k * 37 % 1440).alias("minute"), F.when(k % 3 != 0, k % 25).alias("destination"))


def _places(nation):
    n = F.col("n_nationkey").cast("long")
    return nation.select(n.alias("place"), (10 + n % 5 * 0.0015).alias("place_lat"), (106 + F.floor(n / 5) * 0.0015).alias("place_lon"), (n % 11 / 10).alias("crowd"), (n != 13).alias("is_open"), (n % 4 == 1).alias("food"), (n == 20).alias("parking"))


def _kind():
    return F.concat(F.lit("k"), (F.col("place") % 4).cast("string"))


def _context(pairs):
    return evaluate(pairs, *tables(pairs.sparkSession, CONTEXT), {"minute": F.col("minute"), "metres": F.col("metres"), "kind": _kind()})


def _found(customer, orders, nation):
    n = F.col("n_nationkey").cast("long")
    one = nation.select(n.alias("src"), ((n + 1) % 25).alias("dst"), (1.0 + n % 4).alias("weight")).unionByName(nation.filter("n_nationkey % 3 <> 0").select(n.alias("src"), ((n + 7) % 25).alias("dst"), (5.0 + n % 3).alias("weight")))
    edges = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    visits = orders.groupBy(F.col("o_custkey").alias("user"), (F.col("o_orderkey") % 25).alias("place")).agg(F.count("*").alias("visits"))
    alike = C.item_similarity(visits.withColumn("w", F.lit(1.0)), "user", "place", "w")
    seeds = top_k(visits.select("user", F.col("place").alias("item"), F.col("visits").alias("score")), "user", "item", 6).select("user", "item")
    similar = C.recommend(alike, seeds, "user").select("user", F.col("item").alias("place"), "score")

    def boosts(pairs):
        rows = pairs.join(customer.select(F.col("c_custkey").alias("user"), "c_mktsegment"), "user")
        return evaluate(rows, *tables(pairs.sparkSession, BOOSTS), {"kind": _kind(), "size": F.col("place")}, F.col("c_mktsegment"))

    return D.candidates(_requests(customer), _places(nation), edges, visits, similar, _context, boosts)


ENHANCED_SQL = f"""WITH RECURSIVE {WORLD_CTE},
c6 AS MATERIALIZED (SELECT coalesce(gn.rid, lk.rid) AS rid, coalesce(gn.place, lk.place) AS place, round(CASE WHEN raw IS NULL THEN least(100 * score, 12) + 8 ELSE raw + coalesce(least(100 * score, 12), 0) END, 6)::DOUBLE AS raw,
  ['time_morning', 'time_context', 'personal_history', 'route_context', 'route_neighbor', 'ai_context', 'nearby_context', 'collaborative'][coalesce(turn, 7) + 1] AS source FROM gn FULL JOIN lk ON gn.rid = lk.rid AND gn.place = lk.place),
vt AS (SELECT rid, place % 6 AS cl, count(*) AS n FROM dt WHERE metres <= 200 GROUP BY ALL), xc AS (SELECT rid, cl FROM vt QUALIFY row_number() OVER (PARTITION BY rid ORDER BY n DESC, cl) = 1),
mb AS (SELECT rid, place FROM xc JOIN pl ON place % 6 = cl),
sc AS (SELECT rid, place, (CASE WHEN minute BETWEEN 300 AND 720 AND kind IN ('k0', 'k2') THEN 9 ELSE 0 END + CASE WHEN minute > 1000 AND kind = 'k1' THEN 8 ELSE 0 END + CASE WHEN kind = 'k3' THEN 7 ELSE 0 END + CASE WHEN metres > 400 THEN -3 ELSE 0 END
  + CASE WHEN metres > 1000 THEN -20.0 WHEN metres <= 80 THEN 22.0 WHEN metres <= 200 THEN 18 - metres / 200 * 4 WHEN metres <= 500 THEN 12 - (metres - 200) / 300 * 6 ELSE greatest(0.0, 8 - (metres - 500) / 500 * 8) END
  + CASE WHEN crowd >= 0.85 THEN -15 WHEN crowd <= 0.35 THEN 5 ELSE 0 END)::DOUBLE AS total FROM dt WHERE is_open AND metres <= 1000),
al2 AS (SELECT rid, place, round(raw + 0.35 * total, 9) AS combined, source FROM c6 JOIN sc USING (rid, place)
  UNION ALL SELECT rid, place, round(total + 30, 9), 'explore_cluster' FROM mb JOIN sc USING (rid, place) WHERE NOT EXISTS (SELECT 1 FROM c6 WHERE c6.rid = mb.rid AND c6.place = mb.place))
SELECT rid, place, combined, source, row_number() OVER (PARTITION BY rid ORDER BY combined DESC, place) AS rank FROM al2 QUALIFY rank <= 8"""


@query("customer", "orders", "nation", sql=ENHANCED_SQL)
def c12_enhanced_list(customer, orders, nation):
    """Each customer's eight best places: candidates with a share of their context's score, and what the cluster around has besides."""
    requests, places = _requests(customer), _places(nation)
    found = cut(_found(customer, orders, nation))
    grouped = places.select("place", "place_lat", "place_lon", (F.col("place") % 6).alias("cluster"))
    around = X.explore_clusters(requests, grouped, "rid", 200.0)
    members = cut(around.select("rid", "cluster").join(grouped.select("place", "cluster"), "cluster").select("rid", "place"))
    pairs = found.select("rid", "place").unionByName(members).distinct().join(requests.select("rid", "lat", "lon", "minute"), "rid").join(places, "place")
    pairs = cut(pairs.withColumn("metres", F.round(haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")), 3)).select("rid", "place", "minute", "metres", "crowd", "is_open"))
    return D.enhanced(found, members, D.context_scores(pairs, _context))


_TOKENS = r"[x for x in regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+') if len(x) >= 2 or regexp_matches(x, '^[0-9]+$')]"


@query("lineitem", "orders", "customer", "part", sql=rf"""WITH {SIM_CTE},
s0 AS (SELECT o_custkey AS u, l_partkey AS p, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 4 <> 0 GROUP BY ALL),
s AS (SELECT u, p FROM s0 QUALIFY row_number() OVER (PARTITION BY u ORDER BY q DESC, p) <= 6),
r AS (SELECT a, b, round(sim, 6) AS sim FROM sim WHERE round(sim, 6) >= 0.01), t AS (SELECT a, b, sim FROM r UNION ALL SELECT b, a, sim FROM r),
h AS (SELECT u, b, round(sum(sim), 6) AS score FROM s JOIN t ON s.p = t.a WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.u = s.u AND z.p = t.b) GROUP BY ALL),
hot AS (SELECT u AS custkey, b AS item, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, b) AS rank FROM h QUALIFY rank <= 5),
ci AS (SELECT c_custkey AS custkey, ['red', 'blue', 'hot', 'cold', 'old', 'new'][c_custkey % 6 + 1] || ' ' || ['ring', 'bolt', 'gear', 'rod'][c_custkey % 4 + 1] || ' lover' AS text FROM customer WHERE c_custkey NOT IN (SELECT custkey FROM hot)),
ip AS (SELECT p_partkey AS item, {_TOKENS.format("p_name || ' ' || p_type")} AS w FROM part),
tf AS (SELECT item, term, count(*) / len(w)::DOUBLE AS tf FROM (SELECT item, w, unnest(w) AS term FROM ip) GROUP BY item, term, len(w)),
df AS (SELECT term, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
tw AS (SELECT item, term, tf * idf AS w FROM tf JOIN df USING (term)), tn AS (SELECT item, sqrt(sum(w * w)) AS norm FROM tw GROUP BY item),
q AS (SELECT custkey, term, 1 / 3.0::DOUBLE * idf AS v FROM (SELECT custkey, unnest({_TOKENS.format("text")}) AS term FROM ci) JOIN df USING (term)), qn AS (SELECT custkey, sqrt(sum(v * v)) AS norm FROM q GROUP BY custkey),
cs AS (SELECT custkey, item, round(sum(v * w) / (any_value(tn.norm) * any_value(qn.norm)), 6) AS score FROM q JOIN tw USING (term) JOIN tn USING (item) JOIN qn USING (custkey) GROUP BY ALL)
SELECT custkey, item, score, rank, 'similar' AS source FROM hot
UNION ALL SELECT custkey, item, score, row_number() OVER (PARTITION BY custkey ORDER BY score DESC, item) AS rank, 'interests' FROM cs WHERE score >= 0.05 QUALIFY rank <= 8""")
def c5_cold_start(lineitem, orders, customer, part):
    """Parts like those that a customer bought; for customers without a history (every fourth's is taken as unknown) parts by what they say they like."""
    similar = C.item_similarity(_visits(lineitem), "l_orderkey", "l_partkey", "w")
    seeds = _most_bought(lineitem, orders.filter("o_custkey % 4 <> 0")).select("custkey", "item")
    found = C.recommend(similar, seeds, "custkey").select("custkey", "item", "score", "rank")
    k = F.col("c_custkey")
    word = lambda ws, n: F.element_at(F.array(*map(F.lit, ws)), (k % n + 1).cast("int"))
    interests = customer.select(k.alias("custkey"), F.concat_ws(" ", word(("red", "blue", "hot", "cold", "old", "new"), 6), word(("ring", "bolt", "gear", "rod"), 4), F.lit("lover")).alias("text"))
    items = part.select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return D.with_cold_start(found, interests, items, "custkey", "item")
