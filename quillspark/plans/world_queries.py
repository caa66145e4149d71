"""Table chunks, gated diffusion, knowledge graphs, growing graphs, clusters and rankings with chance."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import explore as X
from quillspark.operators import graphs as G
from quillspark.operators import knowledge as K
from quillspark.operators import retrieval as R
from quillspark.operators.tables import is_table, table_chunks

from .register import query


@query("documents")
def g4_table_chunks(docs):
    """The texts that are tables, in chunks of whole rows under their first row."""
    return table_chunks(docs)


@query("documents", sql="""WITH l AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_replace(x, '\\s', '', 'g') <> ''] AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS lines, len([x for x in l if contains(x, '|')])::BIGINT AS barred FROM l WHERE len([x for x in l if contains(x, '|')]) >= 2 AND len([x for x in l if contains(x, '|')]) >= 0.35 * len(l)""")
def g4_tables(docs):
    """The texts that are tables, their lines and the lines with a bar."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"\s", "") != "")
    return docs.filter(is_table(F.col("text"))).select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).cast("long").alias("barred"))


_DIM = 64
GATED_CTE = f"""
e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
h AS (SELECT vec_id AS entity, vec_id % 50 AS chunk, 1.0::DOUBLE AS w FROM e),
cv AS (SELECT chunk, list(m ORDER BY i) AS v FROM (SELECT vec_id % 50 AS chunk, i, avg(v[i]) AS m FROM e, range(1, {_DIM} + 1) t(i) GROUP BY ALL) GROUP BY chunk),
q AS (SELECT vec_id AS qid, v FROM e WHERE vec_id % 20 = 0),
st AS (SELECT qid, vec_id AS entity, s AS a FROM (SELECT qid, vec_id, round(list_dot_product(q.v, e.v), 6) AS s FROM q, e) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec_id) <= 5),
gt AS MATERIALIZED (SELECT qid, chunk, s AS sim FROM (SELECT qid, chunk, round(list_dot_product(q.v, cv.v), 6) AS s FROM q, cv) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk) <= 8),
sc AS (SELECT label AS cluster, list(m ORDER BY i) AS m FROM (SELECT label, i, avg(v[i]) AS m FROM e, range(1, {_DIM} + 1) t(i) GROUP BY ALL) GROUP BY label),
se AS MATERIALIZED (SELECT entity, cluster, exp(-d2 / 1.0) AS w FROM (SELECT vec_id AS entity, cluster, round(list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in list_zip(v, m)]), 9) AS d2 FROM e, sc)
  QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY d2, entity) <= 10),
sx AS (SELECT qid, cluster, sum(se.w * a) AS x FROM se JOIN st USING (entity) GROUP BY ALL),
a0 AS MATERIALIZED (SELECT qid, entity, sum(a) AS a FROM (SELECT * FROM st UNION ALL SELECT qid, entity, 0.5 * sum(se.w * x) FROM se JOIN sx USING (cluster) GROUP BY ALL) GROUP BY ALL)"""


def _gated_sql(rounds: int) -> str:
    out = GATED_CTE
    for i in range(1, rounds + 1):
        out += f""",
c{i} AS (SELECT qid, chunk, sum(h.w * a) * any_value(sim) AS x FROM h JOIN a{i - 1} USING (entity) JOIN gt USING (qid, chunk) GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT qid, entity, sum(h.w * x) AS a FROM h JOIN c{i} USING (chunk) GROUP BY ALL HAVING sum(h.w * x) >= 0.01)"""
    return out + ", s AS (" + " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(1, rounds + 1)) + ")"


def _whole_diffusion(emb):
    """Every id divisible by 20 asks; five nearest vectors start, eight nearest chunks (means of their vectors) let through."""
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    start = R.dense(emb, asked, 5).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("entity"), F.col("score").alias("a"))
    parts = emb.select((F.col("vec_id") % 50).alias("chunk"), F.posexplode("embedding").alias("i", "x")).groupBy("chunk", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    chunks = parts.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("embedding"))
    similar = R.dense(chunks.withColumnRenamed("chunk", "vec_id"), asked, 8).select(F.col("query_id").alias("qid"), F.col("vec_id").alias("chunk"), F.col("score").alias("sim"))
    clusters = emb.select(F.col("vec_id").alias("entity"), F.col("label").alias("cluster"), "embedding")
    h = emb.select(F.col("vec_id").alias("entity"), (F.col("vec_id") % 50).alias("chunk"), F.lit(1.0).alias("w"))
    return G.diffuse_gated(h, start, similar, G.semantic_edges(clusters, 10, 1.0, 0.0), top=8), clusters


@query("embeddings", sql=f"WITH {_gated_sql(3)} SELECT qid, entity, round(sum(a), 6) AS w FROM s GROUP BY ALL")
def gr20_diffusion_whole(emb):
    """Activation of vectors for every asker, spread over clusters once and over the chunks nearest to it three times."""
    return _whole_diffusion(emb)[0].withColumn("w", F.round("w", 6))


@query("embeddings", sql=f"WITH {_gated_sql(3)}, n AS (SELECT label, count(*) AS n FROM e GROUP BY label) SELECT qid, label AS cluster, round(sum(a) / any_value(n), 6) AS score FROM s JOIN e ON e.vec_id = s.entity JOIN n USING (label) GROUP BY qid, label")
def gr20_cluster_scores(emb):
    """The mean activation of each label's vectors for every asker."""
    weights, clusters = _whole_diffusion(emb)
    return G.cluster_activation(weights, clusters.select("entity", "cluster")).withColumn("score", F.round("score", 6))


#: Names in a text, and the kinds that their endings show.
NAME = "[A-Z][a-z]{5,}"
KINDS = (("tion", "event"), ("ment", "event"), ("keit", "state"))


def _found(docs):
    """Chunks (documents of a source, in its language as section), the first forty names of each as entities, and relations between neighbours of them."""
    chunks = docs.select(F.col("doc_id").alias("chunk"), "source", F.when(F.col("lang") != "en", F.col("lang")).alias("section"))
    names = docs.select(F.col("doc_id").alias("chunk"), F.posexplode(F.regexp_extract_all("text", F.lit(NAME), F.lit(0))).alias("pos", "name"))
    kind = F.lit(None).cast("string")
    for ending, k in reversed(KINDS):
        kind = F.when(F.endswith("name", F.lit(ending)), k).otherwise(kind)
    after = names.select("chunk", (F.col("pos") - 1).alias("pos"), F.col("name").alias("object"))
    relations = names.join(after, ["chunk", "pos"]).select("chunk", "pos", F.col("name").alias("subject"), F.lit("precedes").alias("relation"), "object")
    return chunks, names.filter("pos % 3 = 0").withColumn("kind", kind), relations.filter("pos % 2 = 0")




def _graph_sql() -> str:
    from quillspark.functions.text import FOLD_FROM, FOLD_TO

    fold = lambda c: f"translate(lower({c}), '{FOLD_FROM}', '{FOLD_TO}')"
    return f"""
ch AS (SELECT doc_id AS chunk, source, CASE WHEN lang <> 'en' THEN lang END AS section FROM documents),
nm AS MATERIALIZED (SELECT chunk, pos, names[pos + 1] AS name FROM (SELECT chunk, names, unnest(range(len(names))) AS pos FROM (SELECT doc_id AS chunk, regexp_extract_all(text, '{NAME}') AS names FROM documents))),
mn AS MATERIALIZED (SELECT chunk, pos, name, {fold("name")} AS key, CASE WHEN name LIKE '%tion' OR name LIKE '%ment' THEN 'EVENT' WHEN name LIKE '%keit' THEN 'STATE' ELSE '' END AS kind FROM nm WHERE pos % 3 = 0 QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY pos) <= 20),
rl AS (SELECT a.chunk, a.pos, a.name AS s, b.name AS o, {fold("a.name")} AS s_key, {fold("b.name")} AS o_key FROM nm a JOIN nm b ON a.chunk = b.chunk AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0),
kp AS MATERIALIZED (SELECT * FROM rl WHERE s_key <> o_key AND (s_key IN (SELECT key FROM mn) OR o_key IN (SELECT key FROM mn))),
en AS MATERIALIZED (
  SELECT key, arg_min(name, o) AS name, CASE WHEN bool_or(o.late = 0) THEN coalesce(arg_min(kind, o) FILTER (kind <> '' AND o.late = 0), '') ELSE 'CONCEPT' END AS kind
  FROM (SELECT key, name, kind, {{'late': 0, 'c': chunk, 'p': pos, 'n': name}} AS o FROM mn UNION ALL SELECT s_key, s, 'CONCEPT', {{'late': 1, 'c': chunk, 'p': pos, 'n': s}} FROM kp UNION ALL SELECT o_key, o, 'CONCEPT', {{'late': 1, 'c': chunk, 'p': pos, 'n': o}} FROM kp) GROUP BY key)"""


@query("documents", sql=f"""WITH {_graph_sql()}
SELECT DISTINCT 'doc::' || source AS node, 'document' AS kind, source AS name, NULL::VARCHAR AS type FROM ch UNION ALL SELECT DISTINCT 'section::' || source || '::' || section, 'section', section, NULL FROM ch WHERE section IS NOT NULL
UNION ALL SELECT 'chunk::' || chunk, 'chunk', chunk::VARCHAR, NULL FROM ch UNION ALL SELECT 'entity::' || key, 'entity', name, nullif(kind, '') FROM en UNION ALL SELECT DISTINCT 'type::' || kind, 'entity_type', kind, NULL FROM en WHERE kind <> ''""")
def gr3_graph_nodes(docs):
    """The nodes of the property graph of documents, their sections, names and kinds."""
    return K.property_graph(*_found(docs))[0]


@query("documents", sql=f"""WITH {_graph_sql()}, mc AS (SELECT DISTINCT chunk, key FROM mn),
ed AS (SELECT 'doc::' || source AS src, 'has_section' AS relation, 'section::' || source || '::' || section AS dst, 0.8 AS weight FROM ch WHERE section IS NOT NULL
UNION SELECT CASE WHEN section IS NULL THEN 'doc::' || source ELSE 'section::' || source || '::' || section END, 'has_chunk', 'chunk::' || chunk, 0.7 FROM ch
UNION SELECT 'entity::' || key, 'mentioned_in', 'chunk::' || chunk, 0.6 FROM mc UNION SELECT 'chunk::' || chunk, 'contains_entity', 'entity::' || key, 0.6 FROM mc
UNION SELECT 'entity::' || key, 'is_type', 'type::' || kind, 0.5 FROM en WHERE kind <> '' UNION SELECT 'entity::' || a.key, 'co_occurs_with', 'entity::' || b.key, 0.9 FROM mc a JOIN mc b ON a.chunk = b.chunk AND a.key <> b.key
UNION SELECT 'entity::' || s_key, 'precedes', 'entity::' || o_key, 1.0 FROM kp)
SELECT src, relation, dst, weight::DOUBLE AS weight FROM ed""")
def gr3_graph_edges(docs):
    """The edges of the property graph: hierarchy, mentions, kinds, co-occurrence, and relations with a known end."""
    return K.property_graph(*_found(docs))[1]


def _spots(supplier):
    k = F.col("s_suppkey")
    features = F.array((k % 2).cast("double"), (k % 5 / 4).cast("double"), F.col("s_acctbal") / 10000)
    return supplier.select(k.cast("string").alias("node"), (10 + k % 37 * 0.0007).alias("lat"), (106 + k % 41 * 0.0009).alias("lon"), features.alias("features"))


@query("supplier", sql="""WITH p AS (SELECT s_suppkey AS k, 10 + s_suppkey % 37 * 0.0007::DOUBLE AS lat, 106 + s_suppkey % 41 * 0.0009::DOUBLE AS lon, [(s_suppkey % 2)::DOUBLE, (s_suppkey % 5) / 4.0::DOUBLE, s_acctbal / 10000] AS f FROM supplier),
l AS (SELECT k, unnest([k // 2, k // 3, k - 2]) AS other FROM p), g AS (SELECT DISTINCT least(k, other) AS u, greatest(k, other) AS v FROM l WHERE k <> other AND other IN (SELECT k FROM p)),
d AS (SELECT u, v, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 2) AS len FROM (SELECT u, v, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM g JOIN p a ON a.k = u JOIN p b ON b.k = v)),
b AS (SELECT u AS k, v AS o, len FROM d UNION ALL SELECT v, u, len FROM d), n AS (SELECT b.k, len, f FROM b JOIN p ON p.k = o)
SELECT p.k::VARCHAR AS node, count(n.k) AS degree, round(coalesce(sum(len), 0), 2) AS length, array_to_string([printf('%.4f', round(x, 4)) for x in CASE WHEN count(n.k) = 0 THEN any_value(p.f) ELSE [avg(n.f[1]), avg(n.f[2]), avg(n.f[3])] END], ',') AS mean FROM p LEFT JOIN n ON n.k = p.k GROUP BY p.k""")
def gr14_grown_graph(supplier):
    """Places that came in by three steps, each linked to some that were there: what the steps kept up to date."""
    spark = supplier.sparkSession
    spots = _spots(supplier)
    nodes, edges = spots.limit(0), spark.createDataFrame([], "u string, v string, length double")
    derived = spark.createDataFrame([], K.DERIVED)
    k = F.col("s_suppkey")
    links = supplier.select(k.cast("string").alias("node"), F.explode(F.array(*(x.cast("string") for x in (F.floor(k / 2), F.floor(k / 3), k - 2)))).alias("other"))
    last = supplier.agg(F.max("s_suppkey")).first()[0] or 0
    for end in (last // 3, last // 2, last):  # a link's other end has a smaller number, so it is there
        now = spots.filter(F.col("node").cast("long") <= end).join(nodes.select("node"), "node", "left_anti")
        nodes, edges, derived = (G.cut(t) for t in K.add_nodes(nodes, edges, derived, now, links.join(now.select("node"), "node", "left_semi")))
    return derived.select("node", "degree", "length", F.array_join(F.transform("mean", lambda x: F.format_string("%.4f", F.round(x * 10_000) / 10_000)), ",").alias("mean"))  # rounded as SQL does, not by the printed number


PLACES_SQL = """
pl AS (SELECT s_suppkey AS place, 10 + s_suppkey % 37 * 0.0007::DOUBLE AS plat, 106 + s_suppkey % 41 * 0.0009::DOUBLE AS plon, CASE WHEN s_suppkey % 7 <> 0 THEN 'c' || s_nationkey % 6 END AS cluster,
  CASE WHEN s_suppkey % 3 = 0 THEN round(0.4 * (s_suppkey % 11 / 10.0::DOUBLE) + 0.6 * (s_suppkey % 13 / 12.0::DOUBLE), 2) ELSE s_suppkey % 11 / 10.0::DOUBLE END AS crowd, s_suppkey % 8 <> 3 AS is_open FROM supplier),
pt AS (SELECT c_custkey AS pid, 10 + c_custkey % 101 * 0.00026::DOUBLE AS lat, 106 + c_custkey % 89 * 0.00042::DOUBLE AS lon FROM customer),
dx AS (SELECT pid, place, plat, plon, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT *, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plon - lon) / 2), 2) AS h FROM pt, pl))"""


def _places(supplier):
    k = F.col("s_suppkey")
    crowd = X.crowd_now(k % 11 / 10, F.when(k % 3 == 0, k % 13 / 12))
    cluster = F.when(k % 7 != 0, F.concat(F.lit("c"), (F.col("s_nationkey") % 6).cast("string")))
    return supplier.select(k.alias("place"), (10 + k % 37 * 0.0007).alias("place_lat"), (106 + k % 41 * 0.0009).alias("place_lon"), cluster.alias("cluster"), crowd.alias("crowd"), (k % 8 != 3).alias("is_open"))


def _points(customer):
    k = F.col("c_custkey")
    return customer.select(k.alias("pid"), (10 + k % 101 * 0.00026).alias("lat"), (106 + k % 89 * 0.00042).alias("lon"))


@query("customer", "supplier", sql=f"""WITH {PLACES_SQL}, v AS (SELECT pid, cluster, count(*) AS n FROM dx JOIN pl USING (place) WHERE metres <= 120 GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY pid)::BIGINT AS near FROM v)
SELECT pid, cluster, n AS votes, near FROM t WHERE cluster IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pid ORDER BY n DESC, cluster) = 1""")
def gr22_explore_clusters(customer, supplier):
    """The cluster that most places within 120 m of each position belong to."""
    return X.explore_clusters(_points(customer), _places(supplier), "pid")


@query("customer", "supplier", "nation", sql=f"""WITH {PLACES_SQL},
rq AS (SELECT pid, place AS busy FROM (SELECT pid, place FROM pt JOIN (SELECT place, row_number() OVER (ORDER BY place) - 1 AS r, count(*) OVER () AS n FROM pl WHERE crowd >= 0.8) ON r = pid % n)),
ct AS (SELECT s_suppkey AS place, unnest([s_suppkey % 4, s_nationkey % 9]) AS category FROM supplier), cd AS (SELECT DISTINCT * FROM ct),
nm AS (SELECT s_suppkey AS place, n_regionkey AS alias FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT pid, busy, place, crowd, metres FROM rq JOIN dx USING (pid) JOIN pl USING (place) WHERE metres <= 400 AND crowd < 0.65 AND is_open AND place <> busy),
s AS (SELECT c.*, round(20.0 * (SELECT count(*) FROM cd x JOIN cd y USING (category) WHERE x.place = c.place AND y.place = c.busy) + 5.0 * (SELECT count(*) FROM nm x JOIN nm y USING (alias) WHERE x.place = c.place AND y.place = c.busy) + CASE WHEN abs(c.place - c.busy) = 10 THEN 25 ELSE 0 END
  + 0.5 * CASE WHEN metres <= 80 THEN 22.0 WHEN metres <= 200 THEN 18 - metres / 200 * 4 ELSE 12 - (metres - 200) / 300 * 6 END, 6)::DOUBLE AS score FROM c)
SELECT pid, place, crowd, metres, score FROM s QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, place) = 1""")
def gr22_calmer_places(customer, supplier, nation):
    """For each customer, who stands somewhere and wants a busy place, the most similar calm place near by."""
    from pyspark.sql import Window

    places = _places(supplier)
    busy = places.filter(F.col("crowd") >= X.BUSY).select("place")
    n = busy.count()  # the busy places are numbered, and each customer wants one of them
    numbered = busy.select((F.row_number().over(Window.orderBy("place")) - 1).alias("r"), F.col("place").alias("busy"))
    requests = _points(customer).withColumn("r", (F.col("pid") % max(1, n)).cast("int")).join(numbered, "r")
    services = supplier.select(F.col("s_suppkey").alias("place"), F.explode(F.array(F.col("s_suppkey") % 4, (F.col("s_nationkey") % 9).cast("long"))).alias("category"))
    names = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("place"), F.col("n_regionkey").alias("alias"))
    similar = supplier.select(F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 10).alias("b"))
    return X.calmer_places(requests, places, services, names, similar, "pid")


_U = "((('0x' || left(md5({}), 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0"
RANKED_SQL = f"""
c AS (SELECT o_custkey AS u, l_partkey AS p, sum(l_quantity) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, p) AS turn FROM c),
g AS (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY CASE WHEN turn <= 10 THEN score / 0.6 - ln(-ln({_U.format("concat_ws('|', 7, u, p)")})) END DESC NULLS LAST, turn) AS place FROM t)"""


def _gumbel(lineitem, orders):
    bought = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("custkey"), F.col("l_partkey").alias("item")).agg(F.sum("l_quantity").alias("score"))
    return X.gumbel_rank(bought, "custkey", "item", seed=7, pool=10)


@query("lineitem", "orders", sql=f"WITH {RANKED_SQL} SELECT u AS custkey, p AS item, place::INTEGER AS place FROM g")
def c8_gumbel_rank(lineitem, orders):
    """Each customer's parts, the first ten dealt anew with noise, the same in every run."""
    return _gumbel(lineitem, orders).select("custkey", "item", "place")


@query("lineitem", "orders", sql=f"""WITH {RANKED_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY u) AS n FROM g),
m AS (SELECT *, CASE WHEN n > 3 AND {_U.format("concat_ws('|', 7, 'move', u)")} <= 0.15 THEN 4 + floor({_U.format("concat_ws('|', 7, 'which', u)")} * (n - 3)) END AS chosen FROM n)
SELECT u AS custkey, p AS item, (CASE WHEN place = chosen THEN 4 WHEN place > 3 AND place < chosen THEN place + 1 ELSE place END)::INTEGER AS place FROM m""")
def c9_epsilon_move(lineitem, orders):
    """The dealt parts, for some customers with one from further down in fourth place."""
    return X.epsilon_move(_gumbel(lineitem, orders), "custkey", seed=7).select("custkey", "item", "place")
