"""Linking questions to documents as places, searches in stages, recall from a memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import cascade as C
from quillspark.operators import fusion as M
from quillspark.operators import graphs as G
from quillspark.operators import retrieval as R
from quillspark.operators.memory import Memory
from quillspark.sources.versions import scratch

from .register import query
from .retrieval_queries import BM25_CTE, TFIDF_CTE

#: Words with which a question asks for something near, and what it may be near.
NEAR, ANCHORS = ("the", "que", "der", "la"), ("tion", "keit", "cion", "eau")
#: Letters of a word that names a service.
SERVICE = 12
#: What a common word adds to the sum of a pair's likeness, which stays far below it.
SHARE = 1024.0


def _forms(rows, key):
    return rows.select(key, "text", T.normalise(F.col("text")).alias("form"))


def _aliases(places):
    """A document's alias is its first two words."""
    two = F.slice(F.filter(F.split("form", r"\s+"), lambda w: w != ""), 1, 2)
    return places.filter(F.size(two) == 2).select("doc_id", F.array_join(two, " ").alias("alias"))


def _near():
    return F.arrays_overlap(F.split("form", r"\s+"), F.array(*map(F.lit, NEAR)))


def _link(asked, places, aliases, least):
    hits = C.link_places(asked, places, aliases, "item_id", "doc_id", _near(), ANCHORS)
    return C.best_and_rest(hits, "item_id", "doc_id", least, 0.05)


def _ids(c):
    return F.array_join(F.transform(c, lambda x: x["doc_id"].cast("string")), ",")


_FOLD = f"translate(lower(text), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_FORM = rf"regexp_replace(trim({_FOLD}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
LINK_CTE = rf"""{TFIDF_CTE},
pf AS (SELECT doc_id, {_FORM} AS form FROM documents), qf AS (SELECT item_id, {_FORM} AS form FROM benchmark),
pa AS (SELECT doc_id, array_to_string(w[1:2], ' ') AS alias FROM (SELECT doc_id, [x for x in regexp_split_to_array(form, '\s+') if x <> ''] AS w FROM pf) WHERE len(w) >= 2),
an AS (SELECT * FROM (VALUES {", ".join(f"('{a}')" for a in ANCHORS)}) t(anchor)),
al AS (SELECT item_id, doc_id, 0.5 * count(*) AS pts FROM qf JOIN pa ON contains(qf.form, alias) AND length(alias) >= 3 GROUP BY ALL),
ac AS (SELECT item_id, doc_id, 0.4 * count(*) AS pts FROM qf JOIN an ON contains(qf.form, anchor) JOIN pf ON contains(pf.form, anchor) WHERE list_has_any(regexp_split_to_array(qf.form, '\s+'), [{", ".join(f"'{w}'" for w in NEAR)}]) GROUP BY ALL),
lk AS (SELECT item_id, doc_id, round(sum(pts), 6) AS score FROM (SELECT item_id, doc_id, score AS pts FROM ts UNION ALL SELECT * FROM al UNION ALL SELECT * FROM ac) GROUP BY ALL),
lr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lk),
ls AS (SELECT item_id, any_value(doc_id) FILTER (rank = 1) AS doc_id, max(score) AS best, round(least(1.0, max(score)), 3) AS score, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4 AND score > 0.05), '') AS alternatives FROM lr GROUP BY item_id)"""


@query("benchmark", "documents", sql=f"WITH {LINK_CTE} SELECT item_id, doc_id, score, alternatives FROM ls WHERE best >= 0.05")
def v25_map_linking(bench, docs):
    """The document that each question is linked to, how surely, and three others."""
    places = _forms(docs, "doc_id")
    out = _link(_forms(bench, "item_id"), places, _aliases(places), 0.05)
    return out.select("item_id", "doc_id", "score", _ids("alternatives").alias("alternatives"))


def _keyword(asked, places):
    """The document whose alias stands as whole words in the question, the longest alias first."""
    padded = lambda c: F.concat(F.lit(" "), F.regexp_replace(c, r"\s+", " "), F.lit(" "))
    aliases = _aliases(places).select("doc_id", padded(F.col("alias")).alias("phrase"))
    found = C.contained(asked.select("item_id", padded(F.col("form")).alias("text")), "item_id", aliases).join(aliases, "phrase")
    hits = R.top_k(found.select("item_id", "doc_id", F.length("phrase").cast("double").alias("score")), "item_id", "doc_id", 4)
    return C.best_and_rest(hits, "item_id", "doc_id", 0.0, 0.0, confidence=False).withColumn("score", F.lit(1.0))


def _function_hits(asked, places, k):
    """The documents with the long words that a question names: 25 points each and 30 times the likeness."""
    long_words = lambda df, key: df.select(key, F.explode(F.array_distinct(F.filter(F.split("form", r"\s+"), lambda w: F.length(w) >= SERVICE))).alias("word"))
    # A common word counts SHARE, over any likeness, so one sum holds both and no pair is a row before the best are known. A blank keeps words from terms.
    service = lambda df, key, name, weight: long_words(df, key).groupBy(key, F.concat(F.lit(" "), "word").alias("term")).agg(F.count("*").cast("double").alias(name)).withColumn(name, weight * F.col(name))
    v, x = R.tfidf_vectors(places.select("doc_id", "text"), asked.select("item_id", "text"), "doc_id", "item_id")
    named = G.cut(service(asked, "item_id", "v", SHARE))
    x = x.unionByName(service(places, "doc_id", "x", 1.0).join(named.select("term").distinct(), "term", "left_semi").select("doc_id", "term", "x"))

    def score(sums):
        n = np.floor(sums / SHARE)
        return M.function_scores(n, np.round(sums - n * SHARE, 6))

    scored = R.sparse_top(G.cut(v.unionByName(named)), x, "item_id", "doc_id", k, places.agg(F.count("*").alias("n_docs")), score, SHARE)
    return R.top_k(scored, "item_id", "doc_id", k)


def _function(asked, places):
    return C.best_and_rest(_function_hits(asked, places, 4), "item_id", "doc_id", 0.0, 0.0, confidence=False)


def _lexical(asked, docs):
    hits = R.bm25(docs.select("doc_id", "text"), asked.select("item_id", "text"), "doc_id", "item_id", 4)
    return C.best_and_rest(hits, "item_id", "doc_id", 0.0, 0.0, confidence=False)


def _top_sql(rows: str) -> str:
    return f"SELECT item_id, any_value(doc_id) FILTER (rank = 1) AS doc_id, max(score) AS score, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4), '') AS alternatives FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ({rows})) GROUP BY item_id"


_SPACED = r"' ' || regexp_replace({}, '\s+', ' ', 'g') || ' '"
_WORDS = rf"SELECT DISTINCT {{0}}, word FROM (SELECT {{0}}, unnest(regexp_split_to_array(form, '\s+')) AS word FROM {{1}}) WHERE length(word) >= {SERVICE}"
CASCADE_SQL = rf"""WITH {LINK_CTE}, {BM25_CTE},
r1 AS ({_top_sql(f"SELECT item_id, doc_id, length({_SPACED.format('alias')})::DOUBLE AS score FROM qf JOIN pa ON contains({_SPACED.format('form')}, {_SPACED.format('alias')})")}),
r2 AS (SELECT * FROM ls WHERE best >= 0.45),
fn AS (SELECT item_id, doc_id, count(*) AS n FROM ({_WORDS.format("item_id", "qf")}) JOIN ({_WORDS.format("doc_id", "pf")}) USING (word) GROUP BY ALL),
r3 AS ({_top_sql("SELECT item_id, doc_id, round(greatest(0, least(100, 25 * n + 30 * coalesce(ts.score, 0))), 2) AS score FROM fn LEFT JOIN ts USING (item_id, doc_id)")}),
r4 AS ({_top_sql("SELECT item_id, doc_id, score FROM bm WHERE rank <= 4")})
SELECT item_id, method, doc_id, score, alternatives FROM (
  SELECT item_id, 'keyword' AS method, 1 AS turn, doc_id, 1.0::DOUBLE AS score, alternatives FROM r1 UNION ALL SELECT item_id, 'link', 2, doc_id, score, alternatives FROM r2
  UNION ALL SELECT item_id, 'function', 3, doc_id, score, alternatives FROM r3 UNION ALL SELECT item_id, 'lexical', 4, doc_id, score, alternatives FROM r4)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY turn) = 1"""


@query("benchmark", "documents", sql=CASCADE_SQL)
def v26_search_cascade(bench, docs):
    """Each question's document by the first of four arms that finds one: alias as keyword, link of 0.45 or more, long words named, words shared."""
    places = _forms(docs, "doc_id")
    aliases = _aliases(places)
    arms = [
        ("keyword", lambda asked: _keyword(asked, places)),
        ("link", lambda asked: _link(asked, places, aliases, 0.45)),
        ("function", lambda asked: _function(asked, places)),
        ("lexical", lambda asked: _lexical(asked, docs)),
    ]
    out = C.cascade(_forms(bench, "item_id"), "item_id", arms)
    return out.select("item_id", "method", "doc_id", F.col("score").cast("double").alias("score"), _ids("alternatives").alias("alternatives"))


def _remembered(emb):
    """A memory that all vectors came into by four additions, the last two of them after the index was last built."""
    rows = emb.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("vec_id").cast("string")).alias("content"), (1 + F.col("vec_id") % 5).alias("reward"), "embedding")
    memory = Memory(emb.sparkSession, scratch(emb.sparkSession, "memory"))
    ends = emb.agg(F.expr("percentile_approx(vec_id, array(0.5, 0.9))").alias("p"), F.max("vec_id").alias("m")).first()
    for end in [*(ends.p or []), None if ends.m is None else ends.m - 4, ends.m]:
        if end is not None:
            memory.add(rows.filter(F.col("id") <= end))
    return memory


def _askers(emb):
    return emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _recall_sql(k: int, where: str) -> str:
    return f"""WITH e AS (SELECT vec_id, 1 + vec_id % 5 AS reward, [x / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-12) for x in embedding::DOUBLE[]] AS v FROM embeddings)
SELECT q.vec_id AS query_id, e.vec_id AS id, CASE WHEN e.vec_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role, 'turn ' || e.vec_id AS content, e.reward, round(list_dot_product(q.v, e.v), 6) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.v), 6) DESC, e.vec_id) AS rank
FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id WHERE {where} QUALIFY rank <= {k}"""


@query("embeddings", sql=_recall_sql(4, "true"))
def c16_memory_recall(emb):
    """The four rows that each asker recalls from a memory with an index and pending rows."""
    return _remembered(emb).recall(_askers(emb), 4, itself=False)


@query("embeddings", sql=_recall_sql(3, "e.reward >= 4"))
def c16_reinforced_recall(emb):
    """The three rows rated four or more that each asker recalls."""
    return _remembered(emb).recall(_askers(emb), 3, reward=4, itself=False)


@query("embeddings", "documents", sql="""WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e), 6) AS score FROM d q JOIN d v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e), 6) DESC, v.vec_id) <= 8)
SELECT query_id, vec_id, score FROM s WHERE score >= 0.15 AND vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def v12_entity_link_known(emb, docs):
    """Each asker's eight nearest entities, those of 0.15 or more that a graph (here the English documents' numbers) has."""
    hits = R.top_k(R.dense(emb, _askers(emb), 9).drop("rank").filter("query_id <> vec_id"), "query_id", "vec_id", 8)
    return hits.filter("score >= 0.15").join(docs.filter("lang = 'en'").select(F.col("doc_id").alias("vec_id")).distinct(), "vec_id", "left_semi").select("query_id", "vec_id", "score")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, {TFIDF_CTE},
m AS (SELECT item_id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.5 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS n FROM bm WHERE rank <= 20 WINDOW w AS (PARTITION BY item_id)),
b AS (SELECT item_id, count(*) AS lexical, count(*) FILTER (n >= 0.72) AS recalled FROM m GROUP BY item_id), t AS (SELECT item_id, count(*) FILTER (score >= 0.05) AS linked, count(*) FILTER (35 * score >= 12) AS told FROM tm WHERE rank <= 20 GROUP BY item_id)
SELECT item_id, coalesce(lexical, 0) AS lexical, coalesce(recalled, 0) AS recalled, coalesce(linked, 0) AS linked, coalesce(told, 0) AS told FROM b FULL JOIN t USING (item_id)""")
def f8_score_thresholds(docs, bench):
    """How many of a question's twenty hits pass each threshold: lexical score over 0, 0.72 of the best as a recall, likeness of 0.05 as a link, 12 points of 35 as context."""
    index = R.term_index(docs, "doc_id")
    lexical = R.min_max(R.bm25(docs, bench, "doc_id", "item_id", 20, index=index), "item_id")
    cosine = R.tfidf(docs, bench, "doc_id", "item_id", 20, index=index)
    a = lexical.groupBy("item_id").agg(F.count("*").alias("lexical"), F.count_if(F.col("norm_score") >= 0.72).alias("recalled"))
    b = cosine.groupBy("item_id").agg(F.count_if(F.col("score") >= 0.05).alias("linked"), F.count_if(35 * F.col("score") >= 12).alias("told"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical", "recalled", "linked", "told")]
    return a.join(b, "item_id", "full").select("item_id", *zero)
