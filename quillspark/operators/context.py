"""Contexts of questions: ordered sections of pieces under one budget of characters each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import FOLD_FROM, FOLD_TO

from .retrieval import select_diverse

_FOLDED = str.maketrans(FOLD_FROM, FOLD_TO)
_SOFT = re.compile(r"(?<=[^\W\d_])\n[ \t]*(?=[^\W\d_])")
_ENDS = re.compile(r"(?<=[.!?\n])\s+")

#: Sections in the order in which they come, with the pieces each takes at most (documents: those chosen).
SECTIONS = ("documents", "paths", "memory", "confirmed", "recent", "note")
MOST_PIECES = {"paths": 4, "memory": 2, "confirmed": 2, "recent": 2, "note": 1}


def word_set(text: str) -> set[str]:
    """Words of a text, folded."""
    return set(re.findall(r"\w+", text.lower().translate(_FOLDED)))


def compress(text: str, words: set[str], budget: int) -> str:
    """The sentences of a text that share most words with a question, in their order, in ``budget`` characters (200 at least).

    A text that fits stays as it is, but for line breaks between a letter and a small letter. Sentences of
    ten characters or fewer are left out. A sentence scores its shared words over the root of its words, the
    first one 0.05 more; from the best on each goes in that fits, until one doesn't and six tenths are used.
    A text without such a sentence is cut.
    """
    budget = max(budget, 200)
    text = _SOFT.sub(lambda m: " " if text[m.end()].islower() else m.group(), text)
    if len(text) <= budget:
        return text
    sentences = [s for s in map(str.strip, _ENDS.split(text)) if len(s) > 10]
    scores = []
    for i, s in enumerate(sentences):
        own = word_set(s)
        scores.append((len(own & words) / len(own) ** 0.5 if own else 0.0) + (0.05 if i == 0 else 0.0))
    kept, used = [], 0
    for i in sorted(range(len(sentences)), key=lambda i: (-scores[i], i)):
        if used + len(sentences[i]) + 2 <= budget:
            kept.append(i)
            used += len(sentences[i]) + 2
        elif used >= 0.6 * budget:
            break
    return ". ".join(sentences[i] for i in sorted(kept)) if kept else text[:budget]


def compress_rows(rows: DataFrame, text: str, question: str, budget: str) -> DataFrame:
    """``rows`` with ``text`` compressed for the question to its row's budget; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            short = [compress(t or "", word_set(q or ""), n) for t, q, n in zip(batch.column(text).to_pylist(), batch.column(question).to_pylist(), batch.column(budget).to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(short, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def plain(text: Column) -> Column:
    """A text without the bars of tables and without runs of blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\|\s*", " "), r"\s{2,}", " "))


def prefix_key(text: Column, length: int = 120) -> Column:
    """What texts share that begin alike: the head of the text in lower case, without bars and with single blanks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\|\s*", " ")
    return F.left(F.trim(F.regexp_replace(F.lower(bare), r"\s+", " ")), F.lit(length))


def best_of_prefix(hits: DataFrame, qid: str = "qid") -> DataFrame:
    """Of each question's hits (qid, item, score, text) that begin alike the one of greatest score, the smaller item among equals."""
    rest = [c for c in hits.columns if c != qid]
    best = F.max_by(F.struct(*rest), F.struct("score", -F.col("item")))
    return hits.groupBy(qid, F.md5(prefix_key(F.col("text"))).alias("_key")).agg(best.alias("x")).select(qid, "x.*")


def chosen_documents(questions: DataFrame, hits: DataFrame, k: int = 6, balance: float = 0.7, most: int = 800, least: int = 300) -> DataFrame:
    """(qid, item, place, body): ``k`` diverse hits a question, each compressed to its share of the score.

    Hits (qid, item, score, text, tag) that begin alike count once; the rest is chosen by maximal marginal
    relevance. A hit's budget is ``most`` times the number of hits times its part of their scores, held in
    ``least`` to ``most``.
    """
    hits = best_of_prefix(hits.select("qid", "item", "score", "text", "tag"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    places = select_diverse(hits.select("qid", "item", "score", words.alias("words")), "qid", k, balance)
    rows = hits.join(places, ["qid", "item"])
    one = Window.partitionBy("qid")
    total = F.sum("score").over(one)
    share = F.col("score") / F.when(total != 0, total).otherwise(1.0)
    budget = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(F.round(most * share * F.count("*").over(one), 6)).cast("int")))
    rows = rows.select("qid", "item", "place", "score", "tag", plain(F.col("text")).alias("text"), budget.alias("budget"))
    asked = questions.select("qid", F.col("text").alias("question"))
    rows = compress_rows(rows.join(asked, "qid"), "text", "question", "budget")
    body = F.concat(F.lit("["), F.coalesce("tag", F.lit("")), F.lit(" | score="), F.format_string("%.4f", "score"), F.lit("]\n"), "text")
    return rows.select("qid", "item", "place", body.alias("body"))


def is_follow_up(text: Column, markers: Sequence[str], fewer_than: int = 12) -> Column:
    """A short text with a word that points back."""
    n = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    return (n < fewer_than) & F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(text), m))


def _piece(rows: DataFrame, section: str, place: Column, body: Column) -> DataFrame:
    """(qid, section, place, body), as many of a section as it takes at most."""
    rows = rows.select("qid", F.lit(SECTIONS.index(section)).alias("section"), place.alias("order"), body.alias("body")).filter("body IS NOT NULL")
    w = Window.partitionBy("qid").orderBy("order", "body")
    rows = rows.withColumn("place", F.row_number().over(w).cast("long"))
    return rows.filter(F.col("place") <= MOST_PIECES[section]).select("qid", "section", "place", "body")


def assemble(
    questions: DataFrame,
    hits: DataFrame,
    paths: DataFrame | None = None,
    memory: DataFrame | None = None,
    confirmed: DataFrame | None = None,
    recent: DataFrame | None = None,
    notes: DataFrame | None = None,
    markers: Sequence[str] = (),
    refused: Sequence[str] = (),
    titles: dict[str, str] | None = None,
    budget: int = 8000,
    k: int = 6,
    balance: float = 0.7,
    recall: float = 0.72,
) -> DataFrame:
    """(qid, context, n_chars, pieces): the context of each question (qid, text), ``budget`` characters at most.

    Sections in order, each under its title: documents (``chosen_documents`` of ``hits``); paths (qid, item,
    place, path, tag) of items that aren't among them; memory (qid, score, role, content) of score
    ``recall`` or more without a ``refused`` phrase, the best first; confirmed answers (qid, score, question,
    answer); the last turns of recent (qid, turn, role, content) if the question follows up (``markers``);
    a note (qid, note). A piece goes in, in this order, if it still fits with its title; one that doesn't is
    passed over, so the budget is never exceeded. A question without pieces has an empty context. ``pieces``
    counts those of each section.
    """
    names = titles or {s: f"== {s} ==" for s in SECTIONS}
    documents = chosen_documents(questions, hits, k, balance)
    pieces = documents.select("qid", F.lit(0).alias("section"), "place", "body")
    if paths is not None:
        rows = paths.join(documents.select("qid", "item"), ["qid", "item"], "left_anti")
        pieces = pieces.unionByName(_piece(rows, "paths", F.struct("place", "item"), F.concat(F.lit("["), F.coalesce("tag", F.lit("")), F.lit("]\nPath: "), "path")))
    if memory is not None:
        bad = F.exists(F.array(*map(F.lit, refused)).cast("array<string>"), lambda p: F.contains(F.lower("content"), p))
        rows = memory.filter((F.col("score") >= recall) & ~bad)
        pieces = pieces.unionByName(_piece(rows, "memory", -F.col("score"), F.concat("role", F.lit(": "), F.left("content", F.lit(200)))))
    if confirmed is not None:
        body = F.concat(F.lit("Q: "), F.left("question", F.lit(150)), F.lit("\nA: "), F.left("answer", F.lit(150)))
        pieces = pieces.unionByName(_piece(confirmed, "confirmed", -F.col("score"), body))
    if recent is not None:
        asks = questions.filter(is_follow_up(F.col("text"), markers)).select("qid")
        last = Window.partitionBy("qid").orderBy(F.desc("turn"), "role", "content")
        rows = recent.join(asks, "qid", "left_semi").withColumn("back", F.row_number().over(last)).filter(F.col("back") <= MOST_PIECES["recent"])
        pieces = pieces.unionByName(_piece(rows, "recent", -F.col("back"), F.concat("role", F.lit(": "), F.left("content", F.lit(200)))))
    if notes is not None:
        pieces = pieces.unionByName(_piece(notes.filter("trim(note) <> ''"), "note", F.lit(0), F.left("note", F.lit(200))))
    # A question's pieces are few (k and MOST_PIECES) and short, so they meet in one row.
    rows = pieces.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("section", "place", "body"))).alias("all"))
    title = F.array(*(F.lit(names[s]) for s in SECTIONS))
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("section"), F.array().cast("array<int>").alias("taken"))

    def add(have: Column, p: Column) -> Column:
        new = F.concat_ws("\n", F.when(have["section"] != p["section"], F.get(title, p["section"])), p["body"])
        whole = F.when(have["text"] == "", new).otherwise(F.concat(have["text"], F.lit("\n"), new))
        fits = F.length(whole) <= budget
        return F.struct(F.when(fits, whole).otherwise(have["text"]).alias("text"), F.when(fits, p["section"]).otherwise(have["section"]).alias("section"), F.when(fits, F.array_append(have["taken"], p["section"])).otherwise(have["taken"]).alias("taken"))

    rows = rows.select("qid", F.aggregate("all", start, add).alias("x"))
    taken = F.coalesce("x.taken", F.array().cast("array<int>"))
    counts = F.transform(F.array(*map(F.lit, range(len(SECTIONS)))), lambda i: F.size(F.filter(taken, lambda s: s == i)))
    context = F.coalesce("x.text", F.lit(""))
    return questions.select("qid").join(rows, "qid", "left").select("qid", context.alias("context"), F.length(context).cast("long").alias("n_chars"), counts.alias("pieces"))
