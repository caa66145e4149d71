"""The rule engine against a plain loop over random rule tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import rules as R

SCHEMA = "id long, who string, kind string, name string, size double, flag boolean, tags array<string>"


def subjects(n=120, seed=2):
    r = random.Random(seed)
    pick = lambda *xs: r.choice([*xs, None])
    return [(i, pick("a", "b", "c"), pick("big", "small"), pick("red ring", "blue rod", "été ring", "ringed red"), pick(0.0, 1.5, 3.0, 10.0), pick(True, False), pick(["x", "y z"], [])) for i in range(n)]


def random_rules(n=60, seed=3):
    r = random.Random(seed)
    asks = [
        lambda: R.when("kind", "is", r.choice(["big", "small"]), negated=r.random() < 0.3),
        lambda: R.when("name", "word", r.choice(["ring", "red", "été", "rod", "red ring"]), negated=r.random() < 0.2),
        lambda: R.when("name", "has", r.choice(["ing", "bl", "é"])),
        lambda: R.when("name", "matches", r.choice(["^red", "(rod|ring)$", "e.*r"])),
        lambda: R.when("size", "between", low=r.choice([None, 1, 3]), high=r.choice([None, 3, 10])),
        lambda: R.when("size", "above", low=r.choice([0, 1.5])),
        lambda: R.when("size", "below", high=r.choice([1.5, 3]), negated=r.random() < 0.3),
        lambda: R.when("size", "is", low=3),
        lambda: R.when("flag", "is", low=r.choice([0, 1])),
        lambda: R.when("tags", "word", "y z"),
        lambda: R.when("kind", "present", negated=r.random() < 0.5),
        lambda: R.when("nothing", "present", negated=r.random() < 0.5),
    ]
    out = []
    for i in range(n):
        clauses = [[r.choice(asks)() for _ in range(r.randint(1, 3))] for _ in range(r.randint(0, 3))]
        more = {"per": "size", "factor": r.choice([0.5, -2.0]), "most": r.choice([2.0, 5.0])} if r.random() < 0.3 else {}
        out.append(R.rule(f"r{i}", r.randint(0, 20), r.randint(-5, 5), r.choice([None, f"because {i}"]), *clauses, rule_set=r.choice(["*", "a", "b", "unused"]), choice=r.choice([None, None, "one", "two"]), **more))
    return out


def plain(made, row):
    facts = {"kind": row[2], "name": row[3], "size": row[4], "flag": None if row[5] is None else float(row[5]), "tags": None if row[6] is None else " ".join(row[6]), "nothing": None}

    def holds(c):
        _, _, _, field, op, negated, word, low, high = c
        v = facts[field]
        text = v if isinstance(v, str) else None
        if v is None:
            met = False
        elif op == "is":
            met = text == word if word is not None else v == low
        elif op == "between":
            met = (low is None or v >= low) and (high is None or v <= high)
        elif op == "above":
            met = v > low
        elif op == "below":
            met = v < high
        elif op == "word":
            met = re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text) is not None
        elif op == "has":
            met = word in text
        elif op == "matches":
            met = re.search(word, text) is not None
        else:
            met = True
        return met != negated

    fired, taken = [], set()
    for (s, name, turn, choice, weight, per, factor, most, reason), conditions in sorted(made, key=lambda x: (x[0][2], x[0][1])):
        clauses = {c[2] for c in conditions}
        if s not in ("*", row[1]) or not all(any(holds(c) for c in conditions if c[2] == k) for k in clauses):
            continue
        if choice is not None and choice in taken:
            continue
        taken.add(choice)
        fired.append((name, weight + (factor * min(facts[per], most) if per and facts[per] is not None else 0.0), reason))
    return [f[0] for f in fired], round(sum(f[1] for f in fired), 9), [f[2] for f in fired if f[2]]


FACTS = {"kind": "kind", "name": "name", "size": "size", "flag": "flag", "tags": "tags"}


@pytest.mark.parametrize("most", [R.MOST_BROADCAST, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize("seed", [3, 4, 5])
def test_random_rules_equal_a_plain_loop(spark, monkeypatch, most, seed):
    monkeypatch.setattr(R, "MOST_BROADCAST", most)
    rows, made = subjects(), random_rules(seed=seed)
    out = R.evaluate(spark.createDataFrame(rows, SCHEMA), *R.tables(spark, made), {k: F.col(v) for k, v in FACTS.items()}, F.col("who"))
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "fired", "points", "reasons"]
    got = {r.id: ([x.rule for x in r.fired], round(r.points, 9), r.reasons) for r in out.collect()}
    want = {r[0]: plain(made, r) for r in rows}
    assert got == want and sum(len(x[0]) for x in want.values()) > 300


def test_no_rules_and_no_subjects(spark):
    none = R.tables(spark, [])
    df = spark.createDataFrame(subjects(3), SCHEMA)
    assert [(r.points, r.fired, r.reasons) for r in R.evaluate(df, *none, {"kind": F.col("kind")}).collect()] == [(0.0, [], [])] * 3
    assert R.evaluate(df.limit(0), *R.tables(spark, random_rules(5)), {"kind": F.col("kind")}).collect() == []


def test_rules_survive_a_round_trip(spark, tmp_path):
    made = random_rules()
    R.write_rules(*R.tables(spark, made), str(tmp_path / "rules"))
    rules, conditions = R.read_rules(spark, str(tmp_path / "rules"))
    assert sorted(map(tuple, rules.collect()), key=str) == sorted((r for r, _ in made), key=str)
    assert sorted(map(tuple, conditions.collect()), key=str) == sorted((c for _, cs in made for c in cs), key=str)


def test_unknown_conditions_are_refused(spark):
    with pytest.raises(ValueError, match="no condition"):
        R.when("kind", "sounds")
    rules, conditions = R.tables(spark, [R.rule("r", 1, 1, "x", [R.when("kind", "is", "big")])])
    df = spark.createDataFrame(subjects(3), SCHEMA)
    with pytest.raises(Exception, match="no condition sounds"):
        R.evaluate(df, rules, conditions.withColumn("op", F.lit("sounds")), {"kind": F.col("kind")}).collect()


def test_first_reason(spark):
    made = [R.rule("b", 2, 0, "second", [R.when("kind", "present")]), R.rule("a", 1, 0, "first", [R.when("size", "above", low=2)])]
    got = {r.id: r.verdict for r in R.first_reason(spark.createDataFrame(subjects(), SCHEMA), *R.tables(spark, made), {"kind": F.col("kind"), "size": F.col("size")}, "verdict", "none").collect()}
    assert got == {r[0]: "first" if r[4] is not None and r[4] > 2 else "second" if r[2] else "none" for r in subjects()}
