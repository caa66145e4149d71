"""Queries over whole tables and whole texts, against brute force."""

import random
import re
from difflib import SequenceMatcher

import numpy as np

from quillspark.operators.chunking import split_documents
from quillspark.operators.evaluation import common_length
from quillspark.plans import relational_queries, retrieval_queries, text_queries


def test_dense_asks_every_twentieth_of_all_rows(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(130, 8)).astype(np.float32)
    v[5], v[60] = 3 * v[40], 2 * v[100]  # the nearest of 40 is among the first ten ids, and queries find each other
    emb = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r["rank"]): r.vec_id for r in retrieval_queries.v1_dense_topk_whole(emb).collect()}
    dots = np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    want = {(q, k + 1): i for q in range(0, 130, 20) for k, i in enumerate(sorted((i for i in range(130) if i != q), key=lambda i: (-dots[q, i], i))[:10])}
    assert got == want and got[40, 1] == 5 and got[100, 1] == 60


def test_common_length():
    rng = random.Random(4)
    for n, m in [(0, 3), (3, 0), (1, 1), (7, 40), (90, 70), (130, 20)]:
        a, b = ([rng.choice("abcdef") for _ in range(k)] for k in (n, m))
        rows = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                rows[i + 1][j + 1] = rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
        assert common_length(a, b) == rows[n][m]


def test_answers_are_whole_texts_of_hits(spark):
    item = "alpha bravo charlie delta echo"
    long = "noise " * 400 + item  # what they share begins after 1,500 characters
    docs = spark.createDataFrame([(1, "other words stand here"), (77, long)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    (r,) = text_queries.s31_rouge_l(docs, bench).collect()
    assert (r.item_id, r.doc_id, r.precision, r.recall) == (1, 77, round(5 / 405, 4), 1.0)
    (r,) = text_queries.s32_sequence_similarity(docs, bench).collect()
    assert (r.doc_id, r.similarity) == (77, round(SequenceMatcher(None, item, long).ratio(), 4))
    (r,) = text_queries.v20_compress(docs, bench).collect()
    assert (r.item_id, r.doc_id) == (1, 77)


def test_names_are_whole_sets(spark, sf):
    own = spark.createDataFrame([(-1, "Zoe met Ann, Bob, NASA, EU and éABC at Rue-12 in Alabama Bavaria Colorado Delaware Estonia Florida")], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(own)
    form = re.compile(r"\b([A-Z][a-zA-Z0-9_\-]{2,}|[A-Z]{2,})\b")
    want = {r.doc_id: sorted(set(form.findall(r.text))) for r in docs.collect()}
    assert {r.doc_id: r.names for r in text_queries.s14_capitalised_whole(docs).collect()} == want
    assert len(want[-1]) == 12 and {"EU", "NASA", "Zoe"} <= set(want[-1])


def test_whole_texts_and_their_ends(spark):
    a, b = "head " * 60 + "seam one two", "seam one two " + "rest " * 60
    docs = spark.createDataFrame([(1, a, "fr", "s"), (2, b, "en", "s"), (3, "Title\n" + "\n".join(["x" * 50] * 100) + "\nLast\nend " + "y" * 60, "en", "t")], "doc_id long, text string, lang string, source string")
    assert {r.doc_id: r.enriched for r in text_queries.j1_contextual_prefix_whole(docs).collect()}[1] == f"type: fr | source: s\n{a}"
    assert [(r.doc_id, r.shared) for r in relational_queries.w6_lag_overlap_whole(docs).collect()] == [(2, 3)]
    lines = [r.i for r in text_queries.s13_heading_carry_whole(docs).collect() if r.doc_id == 3]
    assert sorted(lines) == list(range(1, 104))


def test_headings_split_documents_of_any_length(spark):
    line = "a line of well over sixty characters, which is no heading in any document here."
    parts = ["\n".join([f"Part {k}", *[line] * n]) for k, n in enumerate((3, 0, 500, 7))]
    docs = spark.createDataFrame([(1, "\n".join([line, *parts])), (2, "\n".join(["Only", *[line] * 450])), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.article, r.body) for r in split_documents(docs).collect()]
    whole = {n: b for d, n, b in got if d == 1 and n in (1, 4)}
    assert whole == {1: parts[0], 4: parts[3]} and {n for d, n, _ in got if d == 1} == {1, 3, 4}
    assert sum(b.count("which is no heading") for d, n, b in got if (d, n) == (1, 3)) >= 500
    assert {n for d, n, _ in got if d == 2} == {0} and sum(b.count("which is no heading") for d, _, b in got if d == 2) >= 450
    assert all(b.startswith("Part 2\n") and len(b) <= 850 for d, n, b in got if (d, n) == (1, 3))
    assert not any(d == 3 for d, *_ in got)
