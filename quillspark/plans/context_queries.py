"""Contexts of benchmark questions over whole documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions.text import overlap, tokens
from quillspark.operators import context as C
from quillspark.operators import retrieval as R

from .register import query
from .retrieval_queries import BM25_CTE

#: Words that point back in a question, phrases of answers that say nothing, and the best reward.
MARKERS, REFUSED, GOOD = ("the", "que", "der"), ("not mentioned", "no information", "worthless"), 4


def rated_pairs(chats):
    """(conv_id, turn, question, answer, reward): each answer with the turn before it; conversations are rated 1 to 5 by their number."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = chats.withColumn("question", F.lag("text").over(w)).withColumn("asked_by", F.lag("role").over(w))
    return rows.filter("role = 'assistant' AND asked_by = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"), (1 + F.col("conv_id") % 5).alias("reward"))


def _turns(chats, bench):
    """(qid, score, role, content): the four turns nearest to each question by BM25, their scores scaled to 0 to 1."""
    texts = chats.select(F.xxhash64("conv_id", "turn", "role", "text").alias("id"), "role", "text").dropDuplicates(["id"])
    hits = R.with_documents(R.min_max(R.bm25(texts, bench, "id", "item_id", 4), "item_id"), texts, "id")
    return hits.select(F.col("item_id").alias("qid"), F.col("norm_score").alias("score"), "role", F.col("text").alias("content"))


def _confirmed(chats, bench):
    """(qid, score, question, answer): the three best rated pairs nearest to each question."""
    pairs = rated_pairs(chats).filter(F.col("reward") >= GOOD).withColumn("id", F.xxhash64("conv_id", "turn", "question", "answer")).dropDuplicates(["id"])
    texts = pairs.select("id", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text"))
    return R.with_documents(R.bm25(texts, bench, "id", "item_id", 3), pairs, "id").select(F.col("item_id").alias("qid"), "score", "question", "answer")


def sections(docs, bench, chats):
    """The inputs of ``assemble`` for benchmark questions."""
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 20), docs.select("doc_id", "text", "source", "lang"), "doc_id")
    hits = hits.select(F.col("item_id").alias("qid"), F.col("doc_id").alias("item"), "score", "rank", "text", F.col("source").alias("tag"), "lang")
    path = F.concat(F.lit("d"), F.col("item").cast("string"), F.lit(" -in_source-> "), "tag", F.lit(" -in_lang-> "), "lang")
    paths = hits.select("qid", "item", F.col("rank").alias("place"), path.alias("path"), "tag")
    asked = bench.select(F.col("item_id").alias("qid"), "text")
    recent = chats.select(F.col("conv_id").alias("qid"), "turn", "role", F.col("text").alias("content"))
    long_words = F.filter(tokens(F.col("question")), lambda w: F.length(w) >= 3)
    quality = hits.filter("rank = 1").join(asked.withColumnRenamed("text", "question"), "qid").select("qid", overlap(long_words, tokens(F.col("text"))).alias("q"))
    notes = quality.filter("q < 0.9").select("qid", F.concat(F.lit("found "), F.round(100 * F.col("q")).cast("int").cast("string"), F.lit(" in 100 words")).alias("note"))
    return asked, hits.select("qid", "item", "score", "text", "tag"), paths, _turns(chats, bench), _confirmed(chats, bench), recent, notes


@query("documents", "benchmark", "conversations")
def v19_context(docs, bench, chats):
    """The context of each question: documents, paths, recalled turns, confirmed answers, recent turns and a note, 8,000 characters at most."""
    out = C.assemble(*sections(docs, bench, chats), markers=MARKERS, refused=REFUSED)
    return out.select(F.col("qid").alias("item_id"), "context", "n_chars", "pieces")


@query("documents", "benchmark", sql=rf"""WITH {BM25_CTE}, h AS (SELECT item_id, doc_id, score, left(trim(regexp_replace(lower(regexp_replace(text, '\s*\|\s*', ' ', 'g')), '\s+', ' ', 'g')), 120) AS head FROM bm JOIN bd USING (doc_id) WHERE rank <= 20)
SELECT item_id, doc_id, score FROM h QUALIFY row_number() OVER (PARTITION BY item_id, head ORDER BY score DESC, doc_id) = 1""")
def v19_unique_hits(docs, bench):
    """Each question's twenty hits, of those that begin alike the best."""
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 20), docs.select("doc_id", "text"), "doc_id").withColumnRenamed("doc_id", "item")
    return C.best_of_prefix(hits, "item_id").select("item_id", F.col("item").alias("doc_id"), "score")


@query("documents", "benchmark")
def v20_compress_whole(docs, bench):
    """Each question's three best documents, whole texts compressed to 400 characters for it."""
    hits = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 3), docs.select("doc_id", "text"), "doc_id").withColumn("body", C.plain(F.col("text"))).drop("text").join(bench.withColumnRenamed("text", "question"), "item_id")
    return C.compress_rows(hits.select("item_id", "doc_id", "body", "question", F.lit(400).alias("budget")), "body", "question", "budget").select("item_id", "doc_id", "body")
