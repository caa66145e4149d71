"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_repair, language_id, line_dedup, mixing, phrase_index, quality_classifier, quality_rules, simhash, token_ledger, toxicity

LONG = "lorem ipsum dolor " * 40_000
ROWS = [
    (1, "a plain text of some words, not long", "en", "s"),
    (1, "a plain text of some words, not long", "en", "s"),
    (2, None, None, None),
    (None, "words without an id", "en", None),
    (None, None, None, None),
    (3, "", "fr", "t"),
    (4, " \n\t ", "fr", "t"),
    (5, LONG, "en", "s"),
    (6, "\n".join(["line again and again"] * 50), "en", "s"),
    (7, "😀 emoji ÀÉÎ ß \u0000 nul", "de", "u"),
]
CLASH = ("n_words", "size", "key", "bucket", "score", "fp", "rep", "label", "row", "place", "t", "w", "h", "y", "k", "class", "at", "line", "dropped", "_id", "first", "start", "n", "u", "v", "held_out", "taken", "target")


@pytest.fixture(scope="module", params=["full", "empty"])
def tables(spark, request):
    rows = ROWS if request.param == "full" else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit("clash") for c in CLASH})
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1)][: len(rows)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    items = spark.createDataFrame([(1, "plain text of some words"), (1, "plain text of some words"), (2, None), (3, ""), (None, "lorem ipsum")][: len(rows)], "item_id long, text string").withColumn("term", F.lit("clash"))
    return docs, labels, items


def same_rows(out, docs):
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    return {r.doc_id: r for r in out.collect()}


def test_quality_rules(tables):
    docs, labels, _ = tables
    got = same_rows(quality_rules.judge(docs, quality_rules.fit(docs, labels)), docs)
    if got:
        assert got[3].base_failed and not got[3].kept and got[3].n_words == 0
        assert got[5].n_words == 120_000 and got[5].n_repeat_words == 120_000
    assert quality_rules.keep(docs, []).columns == docs.columns


def test_mixing(tables):
    docs, *_ = tables
    got = same_rows(mixing.mix(docs), docs)
    if got:
        assert got[3].size == 0 and got[3].taken == 0


def test_line_dedup(tables):
    docs, *_ = tables
    got = same_rows(line_dedup.digest(docs), docs)
    if got:
        assert got[6].n_dropped == 49 and got[4].n_dropped == 0 and got[3].n_dropped == 0
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_ledger(spark, tables, tmp_path):
    docs, labels, _ = tables
    counts = token_ledger.counted(docs)
    total = token_ledger.maintain(labels, token_ledger.TokenLedger(spark, f"file://{tmp_path}/x"), counts).collect()
    assert sum(r.docs for r in total) == (2 * (len(ROWS) - 1) if docs.count() else 0)


def test_toxicity(tables):
    docs, labels, _ = tables
    got = same_rows(toxicity.score(docs, *toxicity.fit(docs, labels)), docs)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language(tables):
    docs, *_ = tables
    got = same_rows(language_id.predict(docs, language_id.fit(docs)), docs)
    if got:
        assert got[3].lang_pred == got[4].lang_pred == got[2].lang_pred == "und" and 0 < got[1].score <= 1


def test_decontamination(tables):
    docs, _, items = tables
    got = same_rows(phrase_index.contamination(docs, items), docs)
    if got:
        assert got[1]["items"] == [1] and got[1].n_hit == 5
        assert got[5].n_hit == 80_000 and got[5]["items"] == []


def test_simhash(tables):
    docs, *_ = tables
    got = same_rows(simhash.near_duplicates(docs), docs)
    if got:
        assert got[3].component_id == got[4].component_id == 2
        assert got[3].fingerprint == "0" * 16


def test_quality_classifier(tables):
    docs, labels, _ = tables
    got = same_rows(quality_classifier.score(docs, quality_classifier.fit(docs, labels)), docs)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, cost string, place string"
    rows = [(None, 1, "user", "x", "", ""), (1, None, None, None, "", ""), (1, 1, "user", "", "", ""), (1, 1, "user", "", "", ""), (2, 0, "assistant", "y" * 100_000, "", "")]
    got = chat_repair.render_roles(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sum(r.conv_id is None for r in got) == 1
    assert chat_repair.render_roles(spark.createDataFrame([], schema)).count() == 0


def test_line_removal_of_a_long_document(spark):
    """A document of 200,000 lines, of which a third goes, in a few seconds; and the shapes of short ones."""
    import time

    lines = [f"l{i}" for i in range(200_000)]
    gone = list(range(0, 200_000, 3))
    rows = [(0, "\n".join(lines), gone), (1, "a", [0]), (2, "a\n\nb\n", [0]), (3, "", []), (4, "x\ny", None), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, text string, dropped array<int>")
    began = time.time()
    got = {r.i: r.t for r in df.select("i", line_dedup.without_lines(F.col("text"), F.col("dropped")).alias("t")).collect()}
    assert time.time() - began < 30
    assert got[0].split("\n") == [x for i, x in enumerate(lines) if i % 3]
    assert [got[i] for i in (1, 2, 3)] == ["", "\nb\n", ""]
