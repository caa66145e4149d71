"""Personas, familiar and new, function matches, relation paths and the context of a graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.scores import visit_weight
from quillspark.operators import graphs as G
from quillspark.operators import persona as P
from quillspark.operators import retrieval as R

from .register import query
from .search_queries import _FORM, _WORDS, TFIDF_CTE, _forms, _function_hits

#: Places (parts of the nation's number) that make up a group, and how much of each.
GROUPS = (("study", 0, 1.0), ("study", 1, 1.0), ("craft", 2, 1.0), ("craft", 0, 1.0), ("sport", 3, 1.0), ("sport", 4, 1.0), ("food", 5, 1.0), ("staff", 6, 1.0), ("guest", 7, 1.0), ("guest", 8, 1.0), ("quiet", 1, 1.0), ("quiet", 2, 0.5), ("group", 5, 0.5), ("group", 4, 1.0))
NAMES = sorted({g for g, _, _ in GROUPS})


@query("orders", sql=f"""WITH v AS (SELECT o_custkey AS u, o_orderkey % 9 AS place, count(*) AS n FROM orders GROUP BY ALL),
w AS (SELECT u, place, round(0.5 * (1 - exp(-0.15 * 4)) + 0.3 * (n % 2 / n::DOUBLE) + 0.2 * least(1.0, ln(1 + n) / ln(31)), 3) - 0.2 AS w FROM v),
g(g, place, share) AS (VALUES {", ".join(f"('{g}', {p}, {s}::DOUBLE)" for g, p, s in GROUPS)}),
s AS (SELECT u, {", ".join(f"round(coalesce(sum(CASE WHEN g = '{n}' THEN w * share END), 0), 9) AS {n}" if n != "group" else "round(coalesce(sum(CASE WHEN g = 'group' THEN w * share END), 0), 9) AS grp" for n in NAMES)} FROM w LEFT JOIN g USING (place) GROUP BY u)
SELECT u AS custkey, CASE WHEN staff > study + craft + sport THEN 'lecturer' WHEN guest > 0.4 AND study + craft + sport < 0.2 THEN 'visitor' ELSE 'student' END AS role, CASE WHEN grp > quiet THEN 'group' ELSE 'silent' END AS style,
coalesce(nullif(array_to_string(list_sort(list_distinct([x for x in [CASE WHEN craft >= 0.3 THEN 'craft' END, CASE WHEN craft >= 0.3 OR study >= 0.3 THEN 'study' END, CASE WHEN sport >= 0.3 THEN 'sport' END, CASE WHEN food >= 0.3 THEN 'food' END] if x IS NOT NULL])), ','), ''), 'study') AS interests FROM s""")
def c11_persona_whole(orders):
    """Each customer's role, style and interests from the weights of where they were."""
    visits = orders.groupBy(F.col("o_custkey").alias("custkey"), (F.col("o_orderkey") % 9).alias("place")).agg(F.count("*").alias("n"))
    weight = visit_weight(F.col("n"), F.lit(4.0), F.col("n") % 2) - 0.2
    groups = orders.sparkSession.createDataFrame([(p, g, s) for g, p, s in GROUPS], "place long, group string, share double")
    w = P.group_weights(visits.select("custkey", "place", weight.alias("weight")), F.broadcast(groups), "custkey", NAMES)
    role = P.role_of(F.col("staff"), F.col("guest"), F.col("study"), F.col("craft"), F.col("sport"))
    interests = P.interests_of([("craft", F.col("craft")), ("study", F.col("craft")), ("sport", F.col("sport")), ("food", F.col("food")), ("study", F.col("study"))], "study")
    return w.select("custkey", role.alias("role"), F.when(F.col("group") > F.col("quiet"), "group").otherwise("silent").alias("style"), F.array_join(interests, ",").alias("interests"))


@query("lineitem", "orders", sql="""WITH c AS (SELECT o_custkey AS u, l_partkey AS p, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), r AS (SELECT u, p, row_number() OVER (PARTITION BY u ORDER BY q DESC, p) AS place FROM c),
v AS (SELECT o_custkey AS u, l_partkey AS p, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY ALL)
SELECT u AS custkey, p AS item, CASE WHEN n >= 1 THEN 'familiar' ELSE 'discovery' END AS bucket, CASE WHEN n >= 1 THEN 0.0 ELSE 4.0 END::DOUBLE AS novelty, row_number() OVER (PARTITION BY u, n IS NULL ORDER BY place, p)::INTEGER AS turn FROM r LEFT JOIN v USING (u, p)""")
def c10_buckets_whole(lineitem, orders):
    """Each customer's parts in order, those of closed orders as familiar, the others as discoveries with a bonus."""
    bought = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("custkey"), F.col("l_partkey").alias("item"), "l_quantity", "o_orderstatus")
    ranked = R.top_k(bought.groupBy("custkey", "item").agg(F.max("l_quantity").alias("score")), "custkey", "item", 1 << 30).select("custkey", "item", F.col("rank").alias("place"))
    visits = bought.filter("o_orderstatus = 'F'").groupBy("custkey", "item").agg(F.count("*").alias("visits"))
    return P.buckets(ranked, visits, "custkey", "item").select("custkey", "item", "bucket", "novelty", "turn")


@query("benchmark", "documents", sql=rf"""WITH {TFIDF_CTE}, pf AS (SELECT doc_id, {_FORM} AS form FROM documents), qf AS (SELECT item_id, {_FORM} AS form FROM benchmark),
fn AS (SELECT item_id, doc_id, count(*) AS n FROM ({_WORDS.format("item_id", "qf")}) JOIN ({_WORDS.format("doc_id", "pf")}) USING (word) GROUP BY ALL),
s AS (SELECT item_id, doc_id, round(greatest(0, least(100, 25 * n + 30 * coalesce(ts.score, 0))), 2) AS score FROM fn LEFT JOIN ts USING (item_id, doc_id))
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def c14_function_match_whole(bench, docs):
    """The five documents whose services (long words) each question names, 25 points a service and 30 for the likeness."""
    return _function_hits(_forms(bench, "item_id"), _forms(docs, "doc_id"), 5)


@query("customer", "supplier", "nation", "region", sql="""WITH RECURSIVE one AS (SELECT 'c' || c_custkey AS src, 'lives_in' AS relation, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey FROM nation),
e AS (SELECT src, dst, min(relation) AS relation FROM (SELECT src, relation, dst FROM one UNION ALL SELECT dst, relation || '_of', src FROM one WHERE dst[1] <> 'n' OR src[1] <> 'c') GROUP BY ALL),
a AS (SELECT c_custkey AS qid, t AS turn, CASE t WHEN 0 THEN 'missing' || c_custkey ELSE 'c' || c_custkey END AS seed, 's' || c_custkey % (SELECT count(*) FROM supplier) AS target FROM customer, range(2) r(t) WHERE c_custkey % 20 = 0),
w AS (SELECT DISTINCT seed, seed AS node, [seed] AS nodes, '' AS told FROM a UNION ALL SELECT w.seed, e.dst, list_append(w.nodes, e.dst), w.told || CASE WHEN w.told <> '' THEN ' ' ELSE '' END || w.node || ' --[' || e.relation || ']-->' FROM w JOIN e ON e.src = w.node WHERE len(w.nodes) < 5 AND NOT list_contains(w.nodes, e.dst)),
b AS (SELECT seed, node, len(nodes) - 1 AS n, told FROM w QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY len(nodes), nodes) = 1)
SELECT qid, a.seed, n::INTEGER AS hops, told || ' ' || target AS path FROM a JOIN b ON b.seed = a.seed AND b.node = target QUALIFY row_number() OVER (PARTITION BY qid ORDER BY turn) = 1""")
def gr7_relation_paths(customer, supplier, nation, region):
    """How each customer whose number is divisible by 20 is related to a supplier: the shortest way over nations and regions, told by its relations."""
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    edge = lambda df, a, relation, b: df.select(a.alias("src"), F.lit(relation).alias("relation"), b.alias("dst"))
    lives = edge(customer, name("c", "c_custkey"), "lives_in", name("n", "c_nationkey"))
    rest = edge(supplier, name("s", "s_suppkey"), "based_in", name("n", "s_nationkey")).unionByName(edge(nation, name("n", "n_nationkey"), "part_of", name("r", "n_regionkey")))
    back = rest.select(F.col("dst").alias("src"), F.concat("relation", F.lit("_of")).alias("relation"), F.col("src").alias("dst"))  # ways lead to suppliers, not back to customers
    n = supplier.count()
    some = customer.filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("s"), (F.col("c_custkey") % max(1, n)).cast("string")).alias("target"))
    seeds = F.array(F.struct(F.lit(0).alias("turn"), name("missing", "qid").alias("seed")), F.struct(F.lit(1).alias("turn"), name("c", "qid").alias("seed")))
    asked = some.select("qid", "target", F.explode(seeds).alias("x")).select("qid", "x.turn", "x.seed", "target")
    return G.relation_paths(lives.unionByName(rest).unionByName(back), asked, 4)


@query("supplier", "nation", "embeddings", sql="""WITH n AS (SELECT s_suppkey AS u, s_nationkey AS nat FROM supplier), v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
e AS (SELECT a.u, b.u AS v, round(greatest(0.15, (list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) + 1) / 2 * CASE WHEN a.u % 2 = 0 AND b.u % 5 <> 0 THEN 1.35 ELSE 1 END), 4) AS attention, CASE WHEN b.u % 5 = 0 THEN 'closed' ELSE 'open' END AS status
  FROM n a JOIN n b ON a.nat = b.nat AND a.u < b.u JOIN v x ON x.vec_id = a.u JOIN v y ON y.vec_id = b.u),
d AS (SELECT k, count(*) AS degree, max(attention) AS best FROM (SELECT u AS k, attention FROM e UNION ALL SELECT v, attention FROM e) GROUP BY k),
k AS (SELECT u, v, row_number() OVER (ORDER BY attention DESC, u, v) AS rank FROM e)
SELECT u, v, status, attention, a.degree AS u_degree, b.degree AS v_degree, CASE WHEN rank <= 8 THEN rank END AS backbone FROM e JOIN d a ON a.k = u JOIN d b ON b.k = v JOIN k USING (u, v)""")
def gr15_graph_context(supplier, nation, emb):
    """The edges between suppliers of one nation with their attention and degrees, and the eight of most attention as the backbone."""
    known = supplier.select("s_suppkey", "s_nationkey").join(emb.select(F.col("vec_id").alias("s_suppkey"), "embedding"), "s_suppkey")
    pairs = G.cosine_edges(known, "s_suppkey", "s_nationkey")
    status = F.when(F.col("v") % 5 == 0, "closed").otherwise("open")
    edges = pairs.select("u", "v", status.alias("status"), G.edge_attention(F.col("cosine"), F.col("u") % 2 == 0, status).alias("attention"), "u_degree", "v_degree")
    return G.context_edges(edges, 8)  # pairs are scored for the best and again for the rows, as writing them takes more
