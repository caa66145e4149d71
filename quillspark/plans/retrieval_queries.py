"""Retrieval queries over documents, benchmark questions and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions.text import overlap, tokens
from quillspark.operators import retrieval as R

from .register import query


def token_sql(c: str) -> str:
    return rf"[x for x in regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+') if len(x) >= 2 or regexp_matches(x, '^[0-9]+$')]"


BM25_CTE = rf"""
bd AS (SELECT doc_id, text, {token_sql("text")} AS w FROM documents),
btf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM bd) GROUP BY ALL),
bdf AS (SELECT term, count(*) AS df FROM btf GROUP BY term),
bst AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM bd),
bq AS (SELECT item_id, unnest({token_sql("text")}) AS term FROM benchmark),
bs AS (SELECT item_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score
       FROM bq JOIN btf USING (term) JOIN bdf USING (term) JOIN bd USING (doc_id), bst GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bs WHERE score > 0)"""
TFIDF_CTE = rf"""
td AS (SELECT doc_id, {token_sql("text")} AS w FROM documents),
ttf AS (SELECT doc_id, term, count(*) / len(w)::DOUBLE AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM td) GROUP BY doc_id, term, len(w)),
tdf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM ttf GROUP BY term),
tw AS (SELECT doc_id, term, tf * idf AS w FROM ttf JOIN tdf USING (term)),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM tw GROUP BY doc_id),
tq0 AS (SELECT item_id, {token_sql("text")} AS w FROM benchmark),
tq AS (SELECT item_id, term, n / len * idf AS v FROM (SELECT item_id, term, count(*) AS n, any_value(len(w))::DOUBLE AS len FROM (SELECT item_id, w, unnest(w) AS term FROM tq0) GROUP BY item_id, term) JOIN tdf USING (term)),
tqn AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM tq GROUP BY item_id),
ts AS (SELECT item_id, doc_id, round(sum(v * w) / (any_value(tn.norm) * any_value(tqn.norm)), 6) AS score FROM tq JOIN tw USING (term) JOIN tn USING (doc_id) JOIN tqn USING (item_id) GROUP BY ALL),
tm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ts)"""
DOT = "list_sum([x * y for x, y in list_zip(a, b)])"
DENSE_CTE = """
dd AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.e, v.e), 6) AS score FROM dd q JOIN dd v ON q.vec_id < 10 AND v.vec_id >= 10),
dm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds)"""


def _arms(docs, bench, k=20):
    """The BM25 and the TF-IDF arm over one written index."""
    index = R.term_index(docs, "doc_id")
    return R.bm25(docs, bench, "doc_id", "item_id", k, index=index), R.tfidf(docs, bench, "doc_id", "item_id", k, index=index)


@query("documents", "benchmark", sql=f"WITH {BM25_CTE} SELECT item_id, doc_id, score, rank FROM bm WHERE rank <= 10")
def v4_bm25_topk(docs, bench):
    return R.bm25(docs, bench, "doc_id", "item_id", 10)


@query("documents", "benchmark", sql=f"WITH {TFIDF_CTE} SELECT item_id, doc_id, score, rank FROM tm WHERE rank <= 10")
def v5_tfidf_cosine_topk(docs, bench):
    return R.tfidf(docs, bench, "doc_id", "item_id", 10)


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, {TFIDF_CTE},
h AS (SELECT item_id, doc_id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT item_id, doc_id, rank FROM tm WHERE rank <= 20),
s AS (SELECT item_id, doc_id, round(sum(1 / (60 + rank)), 6) AS score FROM h GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def v6_rrf(docs, bench):
    return R.reciprocal_rank_fusion(list(_arms(docs, bench)), "item_id", "doc_id")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, {TFIDF_CTE},
n AS (SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS s FROM tm WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)
      UNION ALL SELECT item_id, doc_id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM bm WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id))
SELECT item_id, doc_id, round(sum(0.5 * s), 6) AS score FROM n GROUP BY ALL""")
def v8_weighted_fusion(docs, bench):
    lexical, cosine = _arms(docs, bench)
    return R.weighted_fusion(cosine, lexical, "item_id", "doc_id")


def _dense(emb, k=10):
    asked = emb.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(emb.filter("vec_id >= 10"), asked, k)


@query("embeddings", sql=f"WITH {DENSE_CTE} SELECT query_id, vec_id, score, rank FROM dm WHERE rank <= 10")
def v1_dense_topk(emb):
    return _dense(emb)


@query("embeddings", sql=f"WITH {DENSE_CTE} SELECT query_id, CASE WHEN round(2 - 2 * score, 6) < 1.2 THEN label::VARCHAR ELSE 'UNKNOWN' END AS match, round(2 - 2 * score, 6) AS dist FROM dm WHERE rank = 1")
def v2_nearest_threshold(emb):
    """The label of the nearest vector if its squared distance is under 1.2."""
    dist = F.round(2 - 2 * F.col("score"), 6)
    return _dense(emb, 1).join(emb.select("vec_id", "label"), "vec_id").select("query_id", F.when(dist < 1.2, F.col("label").cast("string")).otherwise("UNKNOWN").alias("match"), dist.alias("dist"))


@query("embeddings", sql="SELECT vec_id, round(2 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm_in, 1.0::DOUBLE AS norm_out FROM embeddings")
def v3_l2_normalise(emb):
    twice = emb.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 2).alias("v"))
    twice = twice.withColumn("u", R.l2_normalise(F.col("v")))
    return twice.select("vec_id", F.round(F.sqrt(R.dot(F.col("v"), F.col("v"))), 6).alias("norm_in"), F.round(F.sqrt(R.dot(F.col("u"), F.col("u"))), 6).alias("norm_out"))


@query("embeddings", sql=f"""WITH {DENSE_CTE} SELECT query_id, vec_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm_score
FROM dm WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)""")
def w3_minmax_arm(emb):
    return R.min_max(_dense(emb), "query_id").select("query_id", "vec_id", F.round("norm_score", 6).alias("norm_score"))


@query("embeddings", sql=f"WITH {DENSE_CTE} SELECT query_id, vec_id, score FROM dm WHERE rank <= 8 AND score >= 0.15")
def v12_entity_link(emb):
    """The eight nearest entities, those from a similarity on."""
    return _dense(emb, 8).filter("score >= 0.15").select("query_id", "vec_id", "score")


@query("embeddings", sql=f"""WITH {DENSE_CTE},
c AS (SELECT label, i, avg(e[i]) AS m FROM dd, range(1, 65) t(i) WHERE vec_id >= 10 GROUP BY ALL),
s AS (SELECT vec_id AS query_id, c.label, round(sum(e[i] * m), 6) AS sim FROM dd, c WHERE vec_id < 10 GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) = 1)
SELECT query_id, vec_id, round(score * CASE WHEN b.sim >= 0.1 AND b.label = dm.label THEN 1.35 ELSE 1 END, 8) AS score FROM dm JOIN b USING (query_id) WHERE rank <= 10""")
def v11_type_boost(emb):
    """Hits of the type whose centroid is nearest to the query count for more."""
    rows = emb.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centers = rows.filter("vec_id >= 10").groupBy("label", "i").agg(F.avg("x").alias("m"))
    asked = rows.filter("vec_id < 10").select(F.col("vec_id").alias("query_id"), "i", "x")
    sims = asked.join(centers, "i").groupBy("query_id", "label").agg(F.round(F.sum(F.col("x") * F.col("m")), 6).alias("sim"))
    best = sims.groupBy("query_id").agg(F.min_by(F.struct("label", "sim"), F.struct(-F.col("sim"), "label")).alias("best"))
    hits = _dense(emb).join(emb.select("vec_id", "label"), "vec_id").join(best, "query_id")
    boost = F.when((F.col("best.sim") >= 0.1) & (F.col("best.label") == F.col("label")), 1.35).otherwise(1.0)
    return hits.select("query_id", "vec_id", F.round(F.col("score") * boost, 8).alias("score"))


#: Every vector whose id is divisible by 20 asks, all vectors answer; none finds itself.
WHOLE_CTE = """
dd AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ds AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_dot_product(q.e, v.e), 6) AS score FROM dd q JOIN dd v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id),
dm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM ds)"""


def _dense_whole(emb, k=10):
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = R.dense(emb, asked, k + 1).drop("rank").filter("query_id <> vec_id")
    return R.top_k(hits, "query_id", "vec_id", k)


@query("embeddings", sql=f"WITH {WHOLE_CTE} SELECT query_id, vec_id, score, rank FROM dm WHERE rank <= 10")
def v1_dense_topk_whole(emb):
    return _dense_whole(emb)


@query("embeddings", sql=f"WITH {WHOLE_CTE} SELECT query_id, CASE WHEN round(2 - 2 * score, 6) < 1.2 THEN label::VARCHAR ELSE 'UNKNOWN' END AS match, round(2 - 2 * score, 6) AS dist FROM dm WHERE rank = 1")
def v2_nearest_threshold_whole(emb):
    """The label of the nearest other vector if its squared distance is under 1.2."""
    dist = F.round(2 - 2 * F.col("score"), 6)
    return _dense_whole(emb, 1).join(emb.select("vec_id", "label"), "vec_id").select("query_id", F.when(dist < 1.2, F.col("label").cast("string")).otherwise("UNKNOWN").alias("match"), dist.alias("dist"))


@query("embeddings", sql=f"""WITH {WHOLE_CTE} SELECT query_id, vec_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS norm_score
FROM dm WHERE rank <= 10 WINDOW w AS (PARTITION BY query_id)""")
def w3_minmax_arm_whole(emb):
    return R.min_max(_dense_whole(emb), "query_id").select("query_id", "vec_id", F.round("norm_score", 6).alias("norm_score"))


@query("embeddings", sql=f"WITH {WHOLE_CTE} SELECT query_id, vec_id, score FROM dm WHERE rank <= 8 AND score >= 0.15")
def v12_entity_link_whole(emb):
    """The eight nearest other entities, those from a similarity on."""
    return _dense_whole(emb, 8).filter("score >= 0.15").select("query_id", "vec_id", "score")


@query("embeddings", sql=f"""WITH {WHOLE_CTE},
c AS (SELECT label, i, avg(e[i]) AS m FROM dd, range(1, 65) t(i) GROUP BY ALL),
s AS (SELECT vec_id AS query_id, c.label, round(sum(e[i] * m), 6) AS sim FROM dd, c WHERE vec_id % 20 = 0 GROUP BY ALL),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, label) = 1)
SELECT query_id, vec_id, round(score * CASE WHEN b.sim >= 0.1 AND b.label = dm.label THEN 1.35 ELSE 1 END, 8) AS score FROM dm JOIN b USING (query_id) WHERE rank <= 10""")
def v11_type_boost_whole(emb):
    """Hits of the type whose centroid, over all vectors, is nearest to the query count for more."""
    rows = emb.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    centers = rows.groupBy("label", "i").agg(F.avg("x").alias("m"))
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "i", "x")
    sims = asked.join(centers, "i").groupBy("query_id", "label").agg(F.round(F.sum(F.col("x") * F.col("m")), 6).alias("sim"))
    best = sims.groupBy("query_id").agg(F.min_by(F.struct("label", "sim"), F.struct(-F.col("sim"), "label")).alias("best"))
    hits = _dense_whole(emb).join(emb.select("vec_id", "label"), "vec_id").join(best, "query_id")
    boost = F.when((F.col("best.sim") >= 0.1) & (F.col("best.label") == F.col("label")), 1.35).otherwise(1.0)
    return hits.select("query_id", "vec_id", F.round(F.col("score") * boost, 8).alias("score"))


def _hits_with_words(docs, bench, k):
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", k), docs.select("doc_id", "text"), "doc_id")
    return hits.withColumn("words", F.array_sort(F.array_distinct(tokens(F.col("text"))))).drop("text")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, h AS (SELECT item_id, doc_id, list_distinct(w) AS w FROM bm JOIN bd USING (doc_id) WHERE rank <= 10)
SELECT x.item_id, x.doc_id AS a, y.doc_id AS b, round(len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w))), 6) AS jaccard
FROM h x JOIN h y ON x.item_id = y.item_id AND x.doc_id < y.doc_id""")
def v13_jaccard_pairs(docs, bench):
    return R.pair_similarity(_hits_with_words(docs, bench, 10), "item_id", "doc_id")


@query("documents", "benchmark")
def v13_mmr_select(docs, bench):
    """Five diverse documents of each question's ten best."""
    return R.select_diverse(_hits_with_words(docs, bench, 10).withColumnRenamed("doc_id", "item"), "item_id", 5).withColumnRenamed("item", "doc_id")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, t AS (SELECT item_id, left(bd.text, 3000) AS ctx FROM bm JOIN bd USING (doc_id) WHERE rank = 1),
s AS (SELECT item_id, list_distinct([x for x in {token_sql("b.text")} if len(x) >= 3]) AS q, {token_sql("ctx")} AS c FROM benchmark b JOIN t USING (item_id))
SELECT item_id, round(CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, list_distinct(c))) / len(q) END, 6) AS quality FROM s""")
def v15_context_quality(docs, bench):
    """Part of a question's longer words that its best document's head holds."""
    top = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 1), docs.select("doc_id", F.left("text", F.lit(3000)).alias("ctx")), "doc_id")
    asked = bench.select("item_id", F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 3).alias("q"))
    return asked.join(top, "item_id").select("item_id", F.round(overlap(F.col("q"), tokens(F.col("ctx"))), 6).alias("quality"))


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, h AS (SELECT item_id, doc_id, length(bd.text) AS len, score, rank, score / sum(score) OVER (PARTITION BY item_id) AS share FROM bm JOIN bd USING (doc_id) WHERE rank <= 6),
b AS (SELECT *, least(len, greatest(300, least(800, floor(round(share * 6 * 800, 3)))))::BIGINT AS budget FROM h),
u AS (SELECT *, coalesce(sum(budget) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)
SELECT item_id, doc_id, budget, used::BIGINT AS used FROM u WHERE used < 3000""")
def w5_context_budget(docs, bench):
    """Shares of the scores set each hit's budget; hits go in until the context is full."""
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 6), docs.select("doc_id", F.length("text").alias("len")), "doc_id")
    one = Window.partitionBy("item_id")
    share = F.col("score") / F.sum("score").over(one)
    hits = hits.withColumn("budget", F.least(F.col("len"), F.greatest(F.lit(300), F.least(F.lit(800), F.floor(F.round(share * 6 * 800, 3))))).cast("long"))
    used = F.coalesce(F.sum("budget").over(one.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return hits.withColumn("used", used).filter("used < 3000").select("item_id", "doc_id", "budget", "used")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE},
g AS (SELECT item_id, doc_id, rank, len(list_intersect(list_distinct({token_sql("b.text")}), list_distinct(w))) / greatest(1, len(list_distinct({token_sql("b.text")}))) AS rel FROM bm JOIN bd USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 10),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rel DESC, doc_id) AS ideal FROM g)
SELECT item_id, round(sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)), 6) AS ndcg FROM o GROUP BY item_id HAVING sum(rel) > 0""")
def w9_ndcg(docs, bench):
    """nDCG of the ten best, a hit as relevant as the part of the question's words that it holds."""
    hits = _hits_with_words(docs, bench, 10).join(bench.select("item_id", tokens(F.col("text")).alias("q")), "item_id")
    hits = hits.withColumn("rel", overlap(F.col("q"), F.col("words")))
    ideal = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("rel"), "doc_id"))
    hits = hits.withColumn("ideal", ideal)
    gain = lambda r: F.sum(F.col("rel") / F.log2(F.col(r) + 1))
    return hits.groupBy("item_id").agg(F.round(gain("rank") / gain("ideal"), 6).alias("ndcg"), F.sum("rel").alias("s")).filter("s > 0").drop("s")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, p AS (SELECT item_id, doc_id, rank, rank <= 5 AS pool, length(bd.text) AS len FROM bm JOIN bd USING (doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY pool DESC, CASE WHEN pool THEN len END, rank) AS place FROM p""")
def o3_pool_rerank(docs, bench):
    """The first five hits ordered anew (shortest first), the tail as it was."""
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 10), docs.select("doc_id", F.length("text").alias("len")), "doc_id").withColumn("pool", F.col("rank") <= 5)
    w = Window.partitionBy("item_id").orderBy(F.desc("pool"), F.when(F.col("pool"), F.col("len")), "rank")
    return hits.select("item_id", "doc_id", F.row_number().over(w).cast("long").alias("place"))
