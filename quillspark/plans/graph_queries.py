"""Graph queries over the star schema's edges and the embeddings' clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graphs as G

from .register import query

#: Nodes of the purchase graph: customers 'c<key>', orders 'o<key>', parts 'p<key>'.
EDGE_CTE = """
e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 1.0::DOUBLE AS weight FROM orders
      UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, max(l_quantity) FROM lineitem GROUP BY ALL),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def _edges(orders, lineitem):
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    first = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit(1.0).alias("weight"))
    return first.unionByName(lineitem.groupBy(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).agg(F.max("l_quantity").alias("weight")))


def _seed(df, node="c1"):
    return df.sparkSession.createDataFrame([(node,)], "node string")


@query("orders", "lineitem", sql=f"""WITH RECURSIVE {EDGE_CTE}, r AS (SELECT 'c1' AS node, 0 AS hop UNION SELECT b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 3)
SELECT node, min(hop)::BIGINT AS hop FROM r GROUP BY node""")
def gr4_khop(orders, lineitem):
    return G.k_hop(_edges(orders, lineitem), _seed(orders), 3)


def _rounds_sql(n: int) -> str:
    out = ""
    for i in range(1, n + 1):
        out += f""", r{i} AS MATERIALIZED (SELECT n.node, 0.15 * s + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} JOIN n USING (node) WHERE NOT out) * s) AS rank
FROM n LEFT JOIN (SELECT dst AS node, sum(rank * share) AS got FROM r{i - 1} JOIN f ON f.src = r{i - 1}.node GROUP BY dst) g ON g.node = n.node)"""
    return out


@query("orders", "lineitem", sql=f"""WITH {EDGE_CTE}, t AS (SELECT src, sum(weight) AS total FROM e GROUP BY src), f AS (SELECT src, dst, weight / total AS share FROM e JOIN t USING (src)),
n AS MATERIALIZED (SELECT node, CASE WHEN node = 'c1' THEN 1.0 ELSE 0.0 END::DOUBLE AS s, node IN (SELECT src FROM t) AS out FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)),
r0 AS (SELECT node, s AS rank FROM n){_rounds_sql(4)} SELECT node, round(rank, 9) AS rank FROM r4 WHERE round(rank, 9) > 0""")
def gr5_ppr(orders, lineitem):
    """Four rounds of personalised PageRank from one customer."""
    return G.personal_pagerank(_edges(orders, lineitem), _seed(orders), 4, tolerance=None).select("node", F.round("rank", 9).alias("rank")).filter("rank > 0")


#: Nations in a ring, each also linked to the one seven on; every third chord is closed.
RING_SQL = """
e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0 + n_nationkey % 4 AS weight FROM nation
      UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 5.0 + n_nationkey % 3 FROM nation WHERE n_nationkey % 3 <> 0)"""


@query("nation", sql=f"""WITH RECURSIVE {RING_SQL}, r AS (SELECT 0 AS node, 0.0::DOUBLE AS cost, 0 AS n UNION SELECT e.dst, r.cost + e.weight, n + 1 FROM r JOIN e ON e.src = r.node WHERE n < 25 AND r.cost < 40)
SELECT node::INTEGER AS node, min(cost) AS cost FROM r GROUP BY node""")
def gr8_weighted_path(nation):
    """Least costs from one place, closed edges left out."""
    k = F.col("n_nationkey")
    ring = nation.select(k.alias("src"), ((k + 1) % 25).alias("dst"), (1.0 + k % 4).alias("weight"), F.lit("open").alias("status"))
    chords = nation.select(k.alias("src"), ((k + 7) % 25).alias("dst"), (5.0 + k % 3).alias("weight"), F.when(k % 3 == 0, "closed").otherwise("open").alias("status"))
    return G.shortest_paths(ring.unionByName(chords), nation.sparkSession.createDataFrame([(0,)], "node int"))


@query("nation", sql="""WITH e AS (SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, 1.0::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 2) % 25, 0.5 FROM nation),
o1 AS (SELECT dst AS node, weight * 0.7 AS offer FROM e WHERE src = 0),
f1 AS (SELECT node, max(offer) AS carried FROM o1 WHERE node <> 0 GROUP BY node),
o2 AS (SELECT dst AS node, carried * weight * 0.7 * 0.7 AS offer FROM f1 JOIN e ON src = node),
f2 AS (SELECT node, max(offer) AS carried FROM o2 WHERE node <> 0 AND node NOT IN (SELECT node FROM f1) GROUP BY node),
o3 AS (SELECT dst AS node, carried * weight * 0.7 * 0.7 * 0.7 AS offer FROM f2 JOIN e ON src = node)
SELECT node::INTEGER AS node, round(sum(offer), 9) AS score FROM (SELECT 0 AS node, 0.0::DOUBLE AS offer UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3) GROUP BY node""")
def gr6_weighted_bfs(nation):
    k = F.col("n_nationkey")
    edges = nation.select(k.alias("src"), ((k + 1) % 25).alias("dst"), F.lit(1.0).alias("weight")).unionByName(nation.select(k.alias("src"), ((k + 2) % 25).alias("dst"), F.lit(0.5).alias("weight")))
    return G.weighted_bfs(edges, nation.sparkSession.createDataFrame([(0,)], "node int"), 3).withColumn("score", F.round("score", 9))


@query("nation", "region", sql="SELECT r_name AS name, n_name AS neighbour FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT n_name, r_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def gr16_neighbours(nation, region):
    pairs = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select(F.col("r_name").alias("name"), F.col("n_name").alias("neighbour")).unionByName(pairs.select(F.col("n_name").alias("name"), F.col("r_name").alias("neighbour")))


@query("part", sql="SELECT lower(p_name) AS name, min(p_partkey) AS p_partkey FROM part GROUP BY lower(p_name)")
def gr17_entity_dedup(part):
    return part.groupBy(F.lower("p_name").alias("name")).agg(F.min("p_partkey").alias("p_partkey"))


@query("documents", sql="SELECT DISTINCT x AS entity, doc_id AS chunk, 1.0::DOUBLE AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{2,}')) AS x FROM documents)")
def gr18_incidence(docs):
    return G.incidence(docs.select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0))).alias("entity"), F.col("doc_id").alias("chunk")))


@query("documents", sql="""WITH r AS (SELECT DISTINCT source AS src, 'in_lang' AS relation, lang AS dst FROM documents UNION ALL SELECT DISTINCT 'd' || doc_id, 'in_source', source FROM documents)
SELECT src, relation, dst FROM r""")
def gr1_property_graph(docs):
    """Edges of documents to sources and of sources to languages."""
    a = docs.select(F.col("source").alias("src"), F.lit("in_lang").alias("relation"), F.col("lang").alias("dst")).distinct()
    return a.unionByName(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("src"), F.lit("in_source").alias("relation"), F.col("source").alias("dst")).distinct())


HYPER = "h AS (SELECT vec_id AS entity, vec_id % 50 AS chunk, 1.0 + label / 10.0 AS w FROM embeddings)"


def _diffusion_sql(rounds: int) -> str:
    out = ", a0 AS (SELECT vec_id AS entity, 1.0::DOUBLE AS a FROM embeddings WHERE vec_id < 5)"
    for i in range(1, rounds + 1):
        out += f""", c{i} AS (SELECT chunk, sum(w * a) * (0.5 / (1 + chunk)) AS x FROM h JOIN a{i - 1} USING (entity) GROUP BY chunk),
a{i} AS MATERIALIZED (SELECT entity, sum(w * x) AS a FROM h JOIN c{i} USING (chunk) GROUP BY entity HAVING sum(w * x) >= 1e-6)"""
    return out + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(rounds + 1)) + ")"


@query("embeddings", sql=f"WITH {HYPER}{_diffusion_sql(3)} SELECT entity, round(sum(a), 6) AS w FROM s GROUP BY entity")
def gr20_diffusion(emb):
    """Three rounds of entity to chunk and back, a chunk gated by its number."""
    h = emb.select(F.col("vec_id").alias("entity"), (F.col("vec_id") % 50).alias("chunk"), (1.0 + F.col("label") / 10.0).alias("w"))
    gates = h.select("chunk").distinct().withColumn("gate", 0.5 / (1 + F.col("chunk")))
    start = emb.filter("vec_id < 5").select(F.col("vec_id").alias("entity"), F.lit(1.0).alias("a"))
    return G.diffuse(h, start, gates).withColumn("w", F.round("w", 6))


@query("nation", sql=f"""WITH RECURSIVE {RING_SQL}, r AS (SELECT 0 AS node, [0] AS path UNION ALL SELECT e.dst, list_append(r.path, e.dst) FROM r JOIN e ON e.src = r.node WHERE len(r.path) < 6 AND NOT list_contains(r.path, e.dst))
SELECT node::INTEGER AS node, min(len(path) - 1)::BIGINT AS hops FROM r GROUP BY node""")
def gr7_fewest_hops(nation):
    """Hops of the shortest relation path to each place within five."""
    k = F.col("n_nationkey")
    ring = nation.select(k.alias("src"), ((k + 1) % 25).alias("dst"), F.lit(1.0).alias("weight"))
    chords = nation.filter("n_nationkey % 3 <> 0").select(k.alias("src"), ((k + 7) % 25).alias("dst"), F.lit(1.0).alias("weight"))
    return G.shortest_paths(ring.unionByName(chords), nation.sparkSession.createDataFrame([(0,)], "node int"), 5).select("node", F.col("cost").cast("long").alias("hops"))


@query("orders", sql="SELECT o_custkey, round(sum(leg), 2) AS length, round(sum(leg) / 80, 6) AS eta FROM (SELECT o_custkey, abs(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS leg FROM orders) WHERE leg IS NOT NULL GROUP BY o_custkey")
def gr10_path_cost(orders):
    """Length of each customer's path through its orders' prices, and the time at 80 a minute (whole cents over 80 have six places, so no tie is rounded)."""
    from pyspark.sql import Window

    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    legs = orders.withColumn("leg", F.abs(F.col("o_totalprice") - before)).filter("leg IS NOT NULL")
    return legs.groupBy("o_custkey").agg(F.round(F.sum("leg"), 2).alias("length"), F.round(F.sum("leg") / 80, 6).alias("eta"))


@query("nation", sql="SELECT n_nationkey AS src, (n_nationkey + 1) % 25 AS dst, CASE WHEN n_nationkey IN (3, 4) THEN 'closed' ELSE 'open' END AS status FROM nation")
def gr11_edge_update(nation):
    """A status change of a few edges, the last word on each."""
    edges = nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") + 1) % 25).alias("dst"), F.lit("open").alias("status"))
    changes = nation.sparkSession.createDataFrame([(3, 4, "closed"), (4, 5, "closed")], "src int, dst int, new string")
    return edges.join(F.broadcast(changes), ["src", "dst"], "left").select("src", "dst", F.coalesce("new", "status").alias("status"))


@query("embeddings", sql=f"WITH {HYPER}{_diffusion_sql(2)}, t AS (SELECT entity, sum(a) AS w FROM s GROUP BY entity) SELECT chunk, round(1.0 + 0.3 * sum(ln(1 + t.w)), 6) AS score FROM h JOIN t USING (entity) GROUP BY chunk")
def gr21_topic_score(emb):
    """Chunks scored anew by the activation of their entities."""
    h = emb.select(F.col("vec_id").alias("entity"), (F.col("vec_id") % 50).alias("chunk"), (1.0 + F.col("label") / 10.0).alias("w"))
    gates = h.select("chunk").distinct().withColumn("gate", 0.5 / (1 + F.col("chunk")))
    active = G.diffuse(h, emb.filter("vec_id < 5").select(F.col("vec_id").alias("entity"), F.lit(1.0).alias("a")), gates, 2).withColumnRenamed("w", "act")
    return h.join(active, "entity").groupBy("chunk").agg(F.round(1.0 + 0.3 * F.sum(F.log1p("act")), 6).alias("score"))


@query(
    "embeddings",
    sql=f"""WITH {HYPER}{_diffusion_sql(2)}, t AS (SELECT entity, sum(a) AS w FROM s GROUP BY entity),
e AS (SELECT chunk, sum(ln(1 + t.w)) AS x FROM (SELECT DISTINCT entity, chunk FROM h) JOIN t USING (entity) GROUP BY chunk),
m AS (SELECT label, avg(coalesce(t.w, 0)) AS mean FROM embeddings LEFT JOIN t ON t.entity = vec_id GROUP BY label),
k AS (SELECT chunk, ln(1 + sum(mean)) AS x FROM (SELECT DISTINCT vec_id % 50 AS chunk, label FROM embeddings) JOIN m USING (label) GROUP BY chunk)
SELECT c.chunk, round(1.0 + 0.3 * coalesce(e.x, 0) + 0.2 * coalesce(k.x, 0), 6) AS score FROM (SELECT DISTINCT chunk FROM h) c LEFT JOIN e USING (chunk) LEFT JOIN k USING (chunk)""",
)
def gr21_topic_score_whole(emb):
    """Every chunk scored anew by the activation of its entities and the mean activation of their clusters."""
    h = emb.select(F.col("vec_id").alias("entity"), (F.col("vec_id") % 50).alias("chunk"), (1.0 + F.col("label") / 10.0).alias("w"))
    gates = h.select("chunk").distinct().withColumn("gate", 0.5 / (1 + F.col("chunk")))
    weights = G.diffuse(h, emb.filter("vec_id < 5").select(F.col("vec_id").alias("entity"), F.lit(1.0).alias("a")), gates, 2)
    hits = h.select("chunk").distinct().withColumn("score", F.lit(1.0))
    scored = G.topic_scores(hits, h, weights, emb.select(F.col("vec_id").alias("entity"), F.col("label").alias("cluster")))
    return scored.select("chunk", F.round("score", 6).alias("score"))
