"""Places, routes, text graphs, crowd levels and small text rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions.text import strip_marks
from quillspark.operators import fusion as M
from quillspark.operators import graphs as G
from quillspark.operators import retrieval as R

from .register import query

PLACES_SQL = """p AS (SELECT s_suppkey, 10 + s_suppkey % 17 / 100.0 AS lat, 106 + s_suppkey % 23 / 100.0 AS lon FROM supplier),
q AS (SELECT n_nationkey, 10 + n_nationkey / 150.0 AS lat, 106 + n_nationkey / 110.0 AS lon FROM nation)"""


@query("supplier", "nation", sql=f"""WITH {PLACES_SQL},
d AS (SELECT s_suppkey, n_nationkey, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT s_suppkey, n_nationkey, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2) AS h FROM p, q))
SELECT s_suppkey, n_nationkey, metres FROM d WHERE metres <= 3000""")
def f9_near_radius(supplier, nation):
    """Places within 3 km of each other: an equal join on grid cells of 0.03 degrees and their neighbours, then the distance."""
    p = supplier.select("s_suppkey", (10 + F.col("s_suppkey") % 17 / 100.0).alias("lat"), (106 + F.col("s_suppkey") % 23 / 100.0).alias("lon"))
    q = nation.select("n_nationkey", (10 + F.col("n_nationkey") / 150.0).alias("qlat"), (106 + F.col("n_nationkey") / 110.0).alias("qlon"))
    cell = lambda c: F.floor(F.col(c) / 0.03)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    wide = q.withColumn("x", around("qlat")).withColumn("y", around("qlon"))
    near = p.withColumn("x", cell("lat")).withColumn("y", cell("lon")).join(wide, ["x", "y"])
    metres = F.round(S.haversine(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon")), 3)
    return near.select("s_suppkey", "n_nationkey", metres.alias("metres")).filter("metres <= 3000")


@query("orders", sql="SELECT o_orderkey, round_even(greatest(0, least(100, (o_totalprice - 50000.003) / 200000 / 60 * 6000)), 1) AS score FROM orders")
def s21_score_clip(orders):
    return orders.select("o_orderkey", S.clip_score((F.col("o_totalprice") - 50000.003) / 200000 * 60).alias("score"))


@query("events", sql="""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN lpad((event_id % 30)::VARCHAR, 2, '0') || ':' || lpad((event_id % 70)::VARCHAR, 2, '0') WHEN 1 THEN (event_id % 24) || ':5' WHEN 2 THEN 'noon' ELSE '12' END AS hhmm FROM events),
h AS (SELECT event_id, hhmm, try_cast(split_part(hhmm, ':', 1) AS INTEGER) AS h, try_cast(nullif(split_part(hhmm, ':', 2), '') AS INTEGER) AS m FROM t)
SELECT event_id, hhmm, CASE WHEN h BETWEEN 0 AND 23 AND m BETWEEN 0 AND 59 THEN h * 60 + m END AS minutes FROM h""")
def s26_parse_time(events):
    k = F.col("event_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    hhmm = F.when(k % 4 == 0, F.concat(two(k % 30), F.lit(":"), two(k % 70))).when(k % 4 == 1, F.concat((k % 24).cast("string"), F.lit(":5"))).when(k % 4 == 2, "noon").otherwise("12")
    return events.select("event_id", hhmm.alias("hhmm")).select("event_id", "hhmm", S.minutes_of_day(F.col("hhmm")).alias("minutes"))


@query("documents", sql="SELECT doc_id, md5(strip_accents(text)) AS bare FROM documents")
def s5_strip_marks(docs):
    """Texts without combining marks, after canonical decomposition."""
    return strip_marks(docs.select("doc_id", "text"), "text").select("doc_id", F.md5("text").alias("bare"))


MARKER = r"^\s*(?:[-*•]|[0-9]+[.)])\s+"


@query("documents", sql=r"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS x FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, i, left(regexp_replace(x, '^\s*(?:[-*•]|[0-9]+[.)])\s+', ''), 180) AS key FROM l WHERE trim(x) <> '')
SELECT doc_id, i::INTEGER AS line, md5(key) AS key FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1""")
def g7_prefix_dedup(docs):
    """The first of the lines of a document that begin alike once list markers are off."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).filter(F.trim("x") != "")
    rows = lines.select("doc_id", (F.col("i") + 1).alias("line"), F.left(F.regexp_replace("x", MARKER, ""), F.lit(180)).alias("key"))
    return rows.groupBy("doc_id", "key").agg(F.min("line").alias("line")).select("doc_id", "line", F.md5("key").alias("key"))


@query("documents", sql=r"""WITH v AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)? ?(?:%|[a-z]+)')) AS x FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+ ([0-9]+)', 1)) AS x FROM documents)
SELECT DISTINCT 'd' || doc_id AS src, 'specifies' AS relation, x AS dst FROM v
UNION SELECT DISTINCT 'd' || doc_id, 'references', 'd' || x FROM r WHERE x <> CAST(doc_id AS VARCHAR)""")
def gr2_text_graph(docs):
    """Edges from documents to the quantities that they state and to the numbers that they refer to."""
    return G.text_graph(docs, "doc_id", r"[0-9]+(?:[.,][0-9]+)? ?(?:%|[a-z]+)", r"[A-Z][a-z]+ ([0-9]+)", "d")


RING = """
e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0 + n_nationkey % 4 AS weight FROM nation
      UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 5.0 + n_nationkey % 3 FROM nation WHERE n_nationkey % 3 <> 0),
r AS (SELECT s AS start, s AS node, 0.0::DOUBLE AS cost, [s] AS path FROM (VALUES (0), (9), (18)) t(s)
      UNION ALL SELECT r.start, e.dst, r.cost + e.weight, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE len(r.path) < 9 AND NOT list_contains(r.path, e.dst)),
b AS (SELECT start, node, cost, path FROM r QUALIFY row_number() OVER (PARTITION BY start, node ORDER BY cost, path) = 1)"""


def _ring(nation):
    k = F.col("n_nationkey").cast("int")
    ring = nation.select(k.alias("src"), ((k + 1) % 25).alias("dst"), (1.0 + k % 4).alias("weight"), F.lit("open").alias("status"))
    return ring.unionByName(nation.select(k.alias("src"), ((k + 7) % 25).alias("dst"), (5.0 + k % 3).alias("weight"), F.when(k % 3 == 0, "closed").otherwise("open").alias("status")))


@query("nation", sql=f"""WITH RECURSIVE {RING} SELECT array_to_string(list_concat((SELECT path FROM b WHERE start = 0 AND node = 9), list_concat((SELECT path[2:] FROM b WHERE start = 9 AND node = 18), (SELECT path[2:] FROM b WHERE start = 18 AND node = 0))), ',') AS path,
(SELECT sum(cost) FROM b WHERE (start, node) IN ((0, 9), (9, 18), (18, 0))) AS cost, false AS all_open""")
def gr9_multi_stop(nation):
    """A round trip over three places, one of which is shut."""
    opens = nation.select(F.col("n_nationkey").cast("int").alias("node"), (F.col("n_nationkey") != 18).alias("is_open"))
    return G.multi_stop(_ring(nation), [0, 9, 18, 0], opens).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "cost", "all_open")


@query("orders", sql="""WITH e AS (SELECT o_orderkey, o_totalprice / 1000 AS w, o_orderkey % 2 = 0 AS roof, CASE o_orderkey % 7 WHEN 0 THEN 'closed' WHEN 1 THEN 'repairing' ELSE 'open' END AS status, o_custkey % 10 / 10.0 AS crowd, cos(o_orderkey) AS sim FROM orders),
a AS (SELECT *, round(greatest(0.15, (sim + 1) / 2 * CASE WHEN roof AND status = 'open' THEN 1.35 ELSE 1 END), 4) AS attention FROM e)
SELECT o_orderkey, attention, round(CASE WHEN status IN ('closed', 'repairing') THEN 999999 ELSE w * CASE WHEN roof THEN 1 ELSE 5 END * (1 + 2.5 * crowd) / greatest(attention, 0.2) END, 7) AS cost FROM a""")
def gr12_edge_cost(orders):
    k = F.col("o_orderkey")
    status = F.when(k % 7 == 0, "closed").when(k % 7 == 1, "repairing").otherwise("open")
    rows = orders.select("o_orderkey", (F.col("o_totalprice") / 1000).alias("w"), (k % 2 == 0).alias("roof"), status.alias("status"), (F.col("o_custkey") % 10 / 10.0).alias("crowd"), F.cos(k.cast("double")).alias("sim"))
    rows = rows.withColumn("attention", G.edge_attention(F.col("sim"), F.col("roof"), F.col("status")))
    return rows.select("o_orderkey", "attention", F.round(G.edge_cost(F.col("w"), F.col("roof"), F.col("status"), F.col("crowd"), F.col("attention"), "rainy"), 7).alias("cost"))


@query("embeddings", sql="""WITH d AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT label, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(e[i]) AS m FROM d, range(1, 65) t(i) GROUP BY ALL) GROUP BY label),
x AS (SELECT vec_id AS entity, c.label AS cluster, round(list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(e, m)]), 9) AS d2 FROM d, c),
n AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY d2, entity) AS rank FROM x)
SELECT entity, cluster, round(exp(-d2 / 0.5), 6) AS w FROM n WHERE rank <= 10 AND exp(-d2 / 0.5) > 1e-9""")
def gr19_semantic_edges(emb):
    """The ten vectors nearest to each given cluster's centre, weighed by distance."""
    return G.semantic_edges(emb.select(F.col("vec_id").alias("entity"), F.col("label").alias("cluster"), "embedding"), 10, 0.5).withColumn("w", F.round("w", 6))


BANDS = [("purchase", 360, 540, 0.55), ("purchase", 690, 780, 0.95), ("click", 480, 660, 0.8), ("click", 840, 990, 0.8), ("view", 990, 1110, 0.85)]
QUIET = {"purchase": 0.4, "click": 0.3, "view": 0.2}


@query("events", sql=f"""WITH b(kind, lo, hi, level) AS (VALUES {", ".join(f"('{k}', {a}, {z}, {v}::DOUBLE)" for k, a, z, v in BANDS)}),
q(kind, level) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in QUIET.items())}),
e AS (SELECT event_id, event_type, hour(ts) * 60 + minute(ts) AS m, CASE WHEN event_id % 50 = 0 THEN value / 1000 END AS live FROM events)
SELECT event_id, coalesce(CASE WHEN live IS NOT NULL THEN least(1, greatest(0, live)) END, max(b.level), max(q.level), 0.2) AS level FROM e LEFT JOIN b ON b.kind = event_type AND m BETWEEN lo AND hi LEFT JOIN q ON q.kind = event_type GROUP BY event_id, live""")
def c13_crowd_forecast(events):
    """A live level where there is one, else that of the kind's time band, else the kind's quiet level."""
    spark = events.sparkSession
    bands, quiet = spark.createDataFrame(BANDS, "event_type string, lo int, hi int, band double"), spark.createDataFrame(list(QUIET.items()), "event_type string, quiet double")
    live = F.when(F.col("event_id") % 50 == 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 1000)))
    rows = events.select("event_id", "event_type", (F.hour("ts") * 60 + F.minute("ts")).alias("m"), live.alias("live"))
    best = bands.groupBy("event_type").agg(F.collect_list(F.struct("lo", "hi", "band")).alias("bands"))  # a fixed rule table
    rows = rows.join(F.broadcast(best), "event_type", "left").join(F.broadcast(quiet), "event_type", "left")
    band = F.array_max(F.transform(F.filter("bands", lambda b: F.col("m").between(b.lo, b.hi)), lambda b: b.band))
    return rows.select("event_id", F.coalesce("live", band, "quiet", F.lit(0.2)).alias("level"))


WANTED = "an economy or promo item of small size"


@query("part", sql=f"""WITH s AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS names FROM part)
SELECT p_partkey, array_to_string(list_sort([x for x in names if contains('{WANTED}', x)]), ' ') AS services, round(greatest(0, least(100, 25 * len([x for x in names if contains('{WANTED}', x)]) + 30 * (p_partkey % 10 / 10.0))), 2) AS score FROM s""")
def c14_function_match(part):
    """Parts whose type's words a request names, 25 points each, and 30 for their likeness."""
    names = F.array_distinct(F.split(F.lower("p_type"), " "))
    rows = part.select("p_partkey", F.array_sort(F.filter(names, lambda x: F.lit(WANTED).contains(x))).alias("found"))
    return rows.select("p_partkey", F.array_join("found", " ").alias("services"), M.function_score(F.size("found"), F.col("p_partkey") % 10 / 10.0).alias("score"))


@query("embeddings", sql="SELECT label, vec_id, rank FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings) WHERE rank <= 5")
def o2_argsort_topk(emb):
    return R.top_k(emb.select("label", "vec_id", F.col("embedding")[0].alias("score")), "label", "vec_id", 5).select("label", "vec_id", "rank")


@query("nation", "region", sql="""SELECT r_name, n_name, count(*) OVER (PARTITION BY r_name) AS n, first_value(n_name) OVER (PARTITION BY r_name ORDER BY length(n_name) DESC, n_name) AS backbone FROM nation JOIN region ON n_regionkey = r_regionkey""")
def gr15_context_rows(nation, region):
    """The rows of a graph's context: each edge with its hub's degree and longest-named neighbour."""
    hub = Window.partitionBy("r_name")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("r_name", "n_name", F.count("*").over(hub).alias("n"), F.first("n_name").over(hub.orderBy(F.desc(F.length("n_name")), "n_name")).alias("backbone"))
