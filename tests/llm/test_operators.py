"""The training-data operators against brute force, their SQL or held-out labels, on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from quillspark.llm import chat_repair, components, language_id, line_dedup, mixing, phrase_index, quality_classifier, quality_rules, registry, simhash, token_ledger, toxicity
from quillspark.llm.workspace import Workspace

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty karst larch mossy north ocean pines quartz ridge stone tidal".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ed"]) for _ in range(n))


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), more.get("source", f"s{i % 3}"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def components_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_quality_statistics(spark):
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 4, 5, 9, 40)]
    texts += ["a b c d e " * 4, "x y\nx y\n\nq", "  lead # and $ trail! \t\v", None, "u v w x y u v w x y z", "A|B|C ÄÖ\n" * 3]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(spark, texts), []).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r.kept == (not r.base_failed)


def test_quality_rules_are_learned(spark):
    rng = random.Random(2)
    texts = [prose(rng, 60) if i % 5 else prose(rng, 60).replace(" ", "### ") for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    rules = quality_rules.fit(docs, labels)
    assert rules
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    assert all(kept[i] == (i % 5 > 0) for i in range(400))
    assert quality_rules.keep(docs, rules).columns == docs.columns
    assert {r.doc_id for r in quality_rules.keep(docs, rules).collect()} == {i for i, k in kept.items() if k}


def test_mixing_budgets(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(60)), "en", None if i % 7 == 0 else f"s{min(i % 11, 3)}", 0) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).collect()
    by = defaultdict(list)
    for r in got:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(k[1] for k in by) - sum(r.size for r in got)) < 1e-6
    for (size, target), rs in by.items():
        assert size == sum(r.size for r in rs)
        assert sum(r.taken for r in rs) == int(target)
        assert target <= 3 * size + 1e-9


def test_line_dedup_by_brute_force(spark):
    rng = random.Random(4)
    base = [prose(rng, 30) for _ in range(25)]
    texts = []
    for i in range(60):
        lines = rng.sample(base, 2)
        near = lines[0].split(" ")
        near[rng.randrange(30)] = "changed"
        texts.append("\n".join([lines[1], " ".join(near), "", prose(rng, 3)]))
    lines = [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if x.strip()]
    sets = [frozenset(x[j : j + 5] for j in range(max(1, len(x) - 4))) for *_, x in lines]
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = components_of(len(lines), links)
    want = defaultdict(list)
    for k, (i, j, _) in enumerate(lines):
        if comp[k] != k:
            want[i].append(j)
    docs = docs_of(spark, texts)
    got = {r.doc_id: r.dropped for r in line_dedup.digest(docs).collect()}
    assert len(got) == 60 and {k: v for k, v in got.items() if v} == dict(want)
    for r in line_dedup.dedup_lines(docs).collect():
        assert r.text == "\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in want.get(r.doc_id, []))
        assert r.n_chars == len(r.text)


def test_hot_line_groups(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "SAMPLE", 2)
    rng = random.Random(5)
    base = prose(rng, 60).split(" ")
    texts = []
    for i in range(80):
        w = list(base)
        w[i % 60] = f"w{i}"
        texts.append(" ".join(w))
    got = line_dedup.digest(docs_of(spark, texts)).collect()
    assert sum(r.n_dropped for r in got) == 79


def test_ledger(spark, sf, tmp_path):
    rows = [("insert", "a", "en", "v", 5, None), ("insert", "a", "en", "v", 7, None), ("insert", None, "en", "v", 2, None)]
    schema = "change string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    ledger = token_ledger.TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    assert ledger.commit("1", spark.createDataFrame(rows, schema))
    assert not ledger.commit("1", spark.createDataFrame(rows, schema))
    assert ledger.commit("2", spark.createDataFrame([("revise", "a", "en", "v", 6, 7), ("delete", None, "en", "v", 2, None)], schema))
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 2, 11)]
    got = registry.op4_token_ledger(spark, sf).collect()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(token_ledger.LEDGER_SQL).fetchall())


def test_ledger_compaction_beside_a_commit(spark, tmp_path, monkeypatch):
    schema = "change string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    ledger = token_ledger.TokenLedger(spark, f"file://{tmp_path}/ledger")
    ledger.commit("1", spark.createDataFrame([("insert", "a", "en", "v", 5, None)], schema))
    listed = ledger.batches

    def late():
        out = listed()
        if not ledger.committed("2"):
            ledger.commit("2", spark.createDataFrame([("insert", "a", "en", "v", 6, None)], schema))
        return out

    monkeypatch.setattr(ledger, "batches", late)
    assert ledger.compact() == 1
    monkeypatch.undo()
    assert [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 2, 11)]
    assert ledger.compact() == 2 and [tuple(r) for r in ledger.totals().collect()] == [("a", "en", "v", 2, 11)]


def test_mixing_spreads_rows_of_one_id(spark):
    rows = [(None if i % 3 else 4, f"words {i} and more", "en", "s", 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.mix(df, weights=(1,)).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got) == 2400
    assert df.select(mixing.random_key()).distinct().count() == 600


def test_toxicity_learns_words_and_forms(spark):
    rng = random.Random(6)
    texts, bad = [], []
    for i in range(900):
        w = prose(rng, 40).split(" ")
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(["vile", "scummy" + rng.choice("abcdefgh"), "rotten"])
        texts.append(" ".join(w))
        bad.append(int(i % 4 == 0))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, b) for i, b in enumerate(bad)], "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.score(docs, *toxicity.fit(docs, labels)).collect() if r.held_out]
    assert sum(r.predicted == bad[r.doc_id] for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id(spark, sf):
    got = registry.op6_language_id(spark, sf)
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    docs = docs_of(spark, ["1234 !!", None, "", "the cat"])
    model = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    assert [r.lang_pred for r in language_id.predict(docs, model).orderBy("doc_id").collect()][:3] == ["und"] * 3


WORD7 = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_hits(texts, items, size=10):
    windows = defaultdict(set)
    for k, t in items:
        w = WORD7.findall(lower(t))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    out = {}
    for i, t in enumerate(texts):
        w = WORD7.findall(lower(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_phrases_by_brute_force(spark):
    rng = random.Random(7)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 11, 25]))) for k in range(12)] + [(12, "Café-NOIR"), (13, "!!"), (14, None), (15, "")]
    texts = [prose(rng, 80) for _ in range(20)]
    for i in range(0, 20, 2):
        passage = items[i // 2][1].upper().replace(" ", ", ")
        texts[i] = f"{texts[i][:50]} {passage} {texts[i][50:]} {' '.join(items[i // 2][1].split(' ')[:10])}"
    texts += ["the café noir", None, "", "amber " * 500]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in phrase_index.contamination(docs_of(spark, texts), bench).collect()}
    assert got == brute_hits(texts, items)
    near = {(r.item_id, r.doc_id) for r in phrase_index.proximity(docs_of(spark, texts), bench, slop=2).collect()}
    assert {(k, i) for i, (_, _, found) in got.items() for k in found} <= near


def near_pairs(texts, items, window=10, slop=2):
    """(item, document) by trying every start."""
    out = set()
    for d, t in enumerate(texts):
        stands = defaultdict(list)
        w = WORD7.findall(lower(t))
        for p, x in enumerate(w):
            stands[x].append(p)
        for k, text in items:
            item = WORD7.findall(lower(text))
            for start in range(-len(item) - slop, len(w) + slop + 1):
                run = 0
                for j, x in enumerate(item):
                    run = run + 1 if any(abs(p - start - j) <= slop for p in stands[x]) else 0
                    if run == min(window, len(item)):
                        out.add((k, d))
    return out


def test_near_matches_by_brute_force(spark):
    rng = random.Random(17)
    items = [(k, prose(rng, rng.choice([1, 3, 9, 12, 25]))) for k in range(12)] + [(12, "Café-NOIR"), (13, "!!"), (14, None), (15, "")]
    texts = [prose(rng, 60) for _ in range(24)]
    for i in range(24):
        w = items[i % 12][1].split(" ")
        for _ in range(i % 4):  # words moved, put in or left out
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, "extra"), lambda: w.pop(at), lambda: w.insert(max(0, at - 2), w.pop(at))])()
            w = w or ["extra"]
        texts[i] = f"{texts[i][:80]} {' '.join(w).upper()} {texts[i][80:]}"
    texts += ["the noir café", "café of the very noir", None, "", "amber " * 300]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in phrase_index.proximity(docs_of(spark, texts), bench).collect()}
    want = near_pairs(texts, items)
    assert got == want and len(want) > len({(k, i) for i, (_, _, found) in brute_hits(texts, items).items() for k in found})


def test_chat_repair_by_enumeration(spark):
    rng = random.Random(8)
    chats, seqs = [], {}
    for c in range(40):
        roles = [rng.choice(["system", "user", "assistant", "bot", None]) for _ in range(rng.randrange(1, 5))]
        seqs[c] = roles
        chats += [(c, t, r, f"t{t}") for t, r in enumerate(roles)]
    got = defaultdict(list)
    for r in chat_repair.render_roles(spark.createDataFrame(chats, "conv_id long, turn long, role string, text string")).collect():
        got[r.conv_id].append(r)
    for c, roles in seqs.items():
        rs = sorted(got[c], key=lambda r: r.place)
        best = min(_cost(roles, s) for s in itertools.product(range(len(chat_repair.MOVES[0])), repeat=len(roles)))
        assert sum(r.cost for r in rs) == best
        whole = "".join(r.rendered for r in rs)
        shown = re.findall(r"<\|(system|user|assistant)\|>", whole)
        assert re.fullmatch("(s)?(ua)+", "".join(x[0] for x in shown)), shown
        assert re.findall(r"t\d", whole) == [f"t{t}" for t in range(len(roles))]


def _cost(roles, picks):
    s, total = chat_repair.START, 0.0
    for r, k in zip(roles, picks):
        moves = chat_repair.MOVES[chat_repair._code(r)]
        if k >= len(moves) or moves[k][0] != s:
            return float("inf")
        s, total = moves[k][1], total + moves[k][2]
    return total + chat_repair.closing_cost(s)


def test_chat_stretches_agree(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["system", "user", "assistant", "x"]), f"{t}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = sum(r.cost for r in chat_repair.render_roles(df).collect())
    monkeypatch.setattr(chat_repair, "STRETCH", 7)
    parts = chat_repair.render_roles(df).orderBy("place").collect()
    assert sum(r.cost for r in parts) == one and [r.place for r in parts] == list(range(60))


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_by_brute_force(spark):
    rng = random.Random(10)
    texts = [None, "", " \t\n", "One", "one  two", "Ünïcode  tëxt\nhere ok"]
    for _ in range(30):
        w = prose(rng, 400).split(" ")
        texts.append(" ".join(w))
        w[5] = "zzz"
        texts.append("  ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    assert [got[i].component_id for i in range(len(texts))] == components_of(len(texts), links)


@pytest.mark.parametrize("hot", [64, 3, 1])
def test_hot_fingerprint_blocks(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(11)
    base = [int(x) for x in rng.integers(0, 1 << 63, 4)]
    fps = {b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 62, (60, 2))} | set(base)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {(r.a, r.b) for r in simhash.near_pairs(df, Workspace(spark, "t")).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if (a ^ b).bit_count() <= 2}


def test_quality_classifier(spark):
    rng = random.Random(12)
    texts = [prose(rng, 60) if i % 3 else prose(rng, 60).replace(" ", "!! ").upper() for i in range(600)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    held = [r for r in quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect() if r.held_out]
    assert held and sum(r.predicted == (r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)


def test_isotonic():
    x, y = quality_classifier.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert list(y) == [0.0, 0.5, 1.0] and list(x) == [1.0, 2.5, 4.0]


def test_connected_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize("name", ["op2_mixing", "op7_decontamination"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert sorted(r.fetchall()) == sorted(tuple(x[c] for c in cols) for x in registry.queries()[name](spark, sf).collect())
