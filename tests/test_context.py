"""Context assembly against a plain loop, on questions of every kind and on the registered query's own inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import FOLD_FROM, FOLD_TO
from quillspark.operators import context as C
from quillspark.plans import catalogue, context_queries
from quillspark.sources.tables import table

TITLES = {s: f"== {s} ==" for s in C.SECTIONS}


def fold(t):
    return "".join(FOLD_TO[FOLD_FROM.index(c)] if c in FOLD_FROM else c for c in t.lower())


def squeeze(text, question, budget):
    """Sentence compression, written out."""
    budget = max(200, budget)
    text = re.sub(r"([^\W\d_])\n[ \t]*([^\W\d_])", lambda m: f"{m[1]} {m[2]}" if m[2].islower() else m[0], text)
    if len(text) <= budget:
        return text
    asked = set(re.findall(r"\w+", fold(question)))
    parts, at = [], 0
    for m in re.finditer(r"(?<=[.!?\n])\s+", text):
        parts.append(text[at : m.start()])
        at = m.end()
    parts = [p.strip() for p in [*parts, text[at:]] if len(p.strip()) > 10]
    value = []
    for n, p in enumerate(parts):
        own = set(re.findall(r"\w+", fold(p)))
        value.append((-((len(own & asked) / len(own) ** 0.5 if own else 0) + (0.05 if n == 0 else 0)), n))
    left, kept = budget, []
    for _, n in sorted(value):
        if len(parts[n]) + 2 > left:
            if budget - left >= 0.6 * budget:
                break
            continue
        left -= len(parts[n]) + 2
        kept.append(n)
    return ". ".join(parts[n] for n in sorted(kept)) if kept else text[:budget]


def plain_context(question, hits, paths, memory, confirmed, recent, notes, markers, refused, budget, k):
    best = {}
    for item, score, text, tag in sorted(hits, key=lambda h: (-h[1], h[0])):
        head = " ".join(re.sub(r"\s*\|\s*", " ", text or "").lower().split())[:120]
        best.setdefault(head, (item, score, text, tag))
    pool = sorted(best.values(), key=lambda h: (-h[1], h[0]))
    bags = {h[0]: set(re.findall(r"\w+", (h[2] or "").lower())) for h in pool}
    chosen, left = (pool, []) if len(pool) <= k else ([], list(pool))
    while left and len(chosen) < k:

        def worth(h):
            near = [len(bags[h[0]] & bags[c[0]]) / len(bags[h[0]] | bags[c[0]]) if bags[h[0]] | bags[c[0]] else 0.0 for c in chosen]
            return 0.7 * h[1] - (0.3 * max(near) if near else 0.0)

        pick = max(left, key=lambda h: (worth(h), -pool.index(h)))
        chosen.append(pick)
        left.remove(pick)
    total = sum(h[1] for h in chosen) or 1.0
    pieces = []
    for item, score, text, tag in chosen:
        room = max(300, min(800, int(round(800 * score / total * len(chosen), 6))))
        bare = re.sub(r"\s{2,}", " ", re.sub(r"\s*\|\s*", " ", text or "")).strip(" ")
        pieces.append(("documents", f"[{tag or ''} | score={score:.4f}]\n{squeeze(bare, question, room)}"))
    taken = {h[0] for h in chosen}
    pieces += [("paths", f"[{tag or ''}]\nPath: {path}") for item, place, path, tag in sorted(paths, key=lambda p: (p[1], p[0])) if item not in taken][:4]
    good = [m for m in memory if m[0] >= 0.72 and not any(p in m[2].lower() for p in refused)]
    pieces += [("memory", f"{role}: {text[:200]}") for _, role, text in sorted(good, key=lambda m: (-m[0], f"{m[1]}: {m[2][:200]}"))[:2]]
    pieces += [("confirmed", f"Q: {q[:150]}\nA: {a[:150]}") for _, q, a in sorted(confirmed, key=lambda c: (-c[0], f"Q: {c[1][:150]}\nA: {c[2][:150]}"))[:2]]
    if len(question.split()) < 12 and any(m in question.lower() for m in markers):
        pieces += [("recent", f"{role}: {text[:200]}") for _, role, text in sorted(sorted(recent, key=lambda r: (-r[0], r[1], r[2]))[:2], key=lambda r: (r[0], [-ord(c) for c in r[1]]))]
    pieces += [("note", n[:200]) for n in notes if n.strip()][:1]
    out, counts, last = "", dict.fromkeys(C.SECTIONS, 0), None
    for section, body in pieces:
        new = body if section == last else f"{TITLES[section]}\n{body}"
        whole = f"{out}\n{new}" if out else new
        if len(whole) <= budget:
            out, last = whole, section
            counts[section] += 1
    return out, [counts[s] for s in C.SECTIONS]


def fixture(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "béta", "gamma", "delta", "the", "que", "ring", "x1", "Élan", "omega"])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + r.choice([". ", "! ", ".\n", "? "])
    text = lambda n: "".join(sentence(r.randint(1, 14)) for _ in range(n)).strip()
    shared = text(20)
    cases = {}
    for q in range(12):
        hits = [(100 * q + i, round(r.uniform(0.1, 20), 6), r.choice([shared + f" {i}", text(r.randint(0, 60)), " a | b || c " + text(9), None, ""]), r.choice(["src", None])) for i in range(r.choice([0, 1, 5, 14]))]
        paths = [(100 * q + r.randint(0, 14), i, f"p{i} -r-> q", r.choice(["t", None])) for i in range(r.choice([0, 7]))]
        memory = [(round(r.random(), 3), r.choice(["user", "assistant"]), text(r.randint(1, 30)) + r.choice(["", " not mentioned"])) for _ in range(r.choice([0, 5]))]
        confirmed = [(round(r.random(), 3), text(3), text(9)) for _ in range(r.choice([0, 3]))]
        recent = [(i, r.choice(["user", "assistant"]), text(4)) for i in range(r.choice([0, 1, 4]))]
        cases[q] = (text(r.choice([1, 1, 9])), hits, paths, memory, confirmed, recent, r.choice([[], ["see page 3"], ["  "]]))
    return cases


@pytest.mark.parametrize("budget", [8000, 900, 40])
def test_assembly_equals_a_plain_loop(spark, budget):
    cases = fixture(7)
    frame = lambda i, schema: spark.createDataFrame([(q, *row) for q, c in cases.items() for row in c[i]], f"qid long, {schema}")
    asked = spark.createDataFrame([(q, c[0]) for q, c in cases.items()], "qid long, text string")
    notes = spark.createDataFrame([(q, n) for q, c in cases.items() for n in c[6]], "qid long, note string")
    out = C.assemble(
        asked,
        frame(1, "item long, score double, text string, tag string"),
        frame(2, "item long, place long, path string, tag string"),
        frame(3, "score double, role string, content string"),
        frame(4, "score double, question string, answer string"),
        frame(5, "turn long, role string, content string"),
        notes,
        markers=["the", "que"],
        refused=["not mentioned"],
        budget=budget,
    )
    got = {r.qid: (r.context, r.pieces) for r in out.collect()}
    assert got.keys() == cases.keys()
    for q, c in cases.items():
        assert got[q] == plain_context(*c, ["the", "que"], ["not mentioned"], budget, 6), q
        assert len(got[q][0]) <= budget


def test_registered_contexts_keep_their_budget(spark, sf):
    rows = catalogue.queries()["v19_context"](spark, sf).collect()
    asked, hits, *_ = context_queries.sections(*(table(spark, sf, t) for t in ("documents", "benchmark", "conversations")))
    assert len(rows) == asked.count() and all(r.n_chars == len(r.context) <= 8000 for r in rows)
    assert all(sum(r.pieces) for r in rows if r.item_id in {h.qid for h in hits.select("qid").distinct().collect()})
    assert sum(r.pieces[0] for r in rows) > len(rows) and all(sum(r.pieces[i] for r in rows) for i in (1, 2, 3))


def test_compression_of_whole_texts(spark, sf):
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    asked = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    rows = catalogue.queries()["v20_compress_whole"](spark, sf).collect()
    for r in rows:
        bare = re.sub(r"\s{2,}", " ", re.sub(r"\s*\|\s*", " ", docs[r.doc_id])).strip(" ")
        assert r.body == squeeze(bare, asked[r.item_id], 400)
    assert any(len(docs[r.doc_id]) > 2000 for r in rows)


def test_without_other_sections(spark):
    asked = spark.createDataFrame([(1, "a question"), (2, None)], "qid long, text string")
    hits = spark.createDataFrame([(1, 5, 2.0, "some text", "s"), (2, 6, 0.0, None, None)], "qid long, item long, score double, text string, tag string")
    got = {r.qid: r.context for r in C.assemble(asked, hits).collect()}
    assert got == {1: "== documents ==\n[s | score=2.0000]\nsome text", 2: "== documents ==\n[ | score=0.0000]\n"}
    assert {r.qid: r.context for r in C.assemble(asked, hits.limit(0)).collect()} == {1: "", 2: ""}
