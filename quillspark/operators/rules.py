"""A rule engine: tables of rules and of their conditions, joined to subjects and evaluated in each row.

A rule belongs to a set and has a turn (its order), a weight, a reason, and optionally a fact whose number,
times ``factor`` and at most ``most``, adds to the weight. Rules of one set and ``choice`` exclude each
other: only the first that holds counts. A rule holds if each of its clauses does; a clause holds if one of
its conditions does; a rule without conditions always holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

RULES = "rule_set string, rule string, turn int, choice string, weight double, per string, factor double, most double, reason string"
CONDITIONS = "rule_set string, rule string, clause int, field string, op string, negated boolean, word string, low double, high double"

#: The set whose rules hold for every subject.
EVERY = "*"
#: Conditions up to which a table of rules is sent to every task; a larger one is joined by a shuffle.
MOST_BROADCAST = 20_000
#: Rules and conditions up to which they are written into the subjects' columns and not joined at all.
MOST_INLINE = 300

#: What a condition may ask of a fact.
OPS = ("is", "between", "above", "below", "word", "has", "matches", "present")


def rule(name: str, turn: int, weight: float = 0.0, reason: str | None = None, *clauses: Iterable[dict], rule_set: str = EVERY, choice: str | None = None, per: str | None = None, factor: float | None = None, most: float | None = None) -> tuple[tuple, list[tuple]]:
    """A row of rules, and the rows of its conditions: each clause a list of ``when(...)``."""
    number = lambda x: None if x is None else float(x)
    return (rule_set, name, turn, choice, float(weight), per, number(factor), number(most), reason), [(rule_set, name, i, *c) for i, clause in enumerate(clauses) for c in clause]


def when(field: str, op: str = "present", word: str | None = None, low: float | None = None, high: float | None = None, negated: bool = False) -> tuple:
    """A condition: ``is`` a word or, without one, the number ``low``; ``between`` low and high, both included; ``above`` low;
    ``below`` high; has the whole ``word`` or words; ``has`` the text; ``matches`` the pattern; is ``present``."""
    if op not in OPS:
        raise ValueError(f"no condition {op}; there are {', '.join(OPS)}")
    return field, op, negated, word, None if low is None else float(low), None if high is None else float(high)


def tables(spark: SparkSession, made: Iterable[tuple]) -> tuple[DataFrame, DataFrame]:
    """The tables of rules and conditions that ``rule(...)`` calls describe."""
    made = list(made)
    return spark.createDataFrame([r for r, _ in made], RULES), spark.createDataFrame([c for _, cs in made for c in cs], CONDITIONS)


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables of rules and conditions from JSON lines, a rule a line with its conditions in ``conditions``."""
    nested = "struct<clause:int,field:string,op:string,negated:boolean,word:string,low:double,high:double>"
    rows = spark.read.schema(f"{RULES}, conditions array<{nested}>").json(path)
    return rows.drop("conditions"), rows.select("rule_set", "rule", F.inline("conditions"))


def write_rules(rules: DataFrame, conditions: DataFrame, path: str) -> None:
    """What ``read_rules`` reads."""
    of = conditions.groupBy("rule_set", "rule").agg(F.sort_array(F.collect_list(F.struct("clause", "field", "op", "negated", "word", "low", "high"))).alias("conditions"))
    rules.join(of, ["rule_set", "rule"], "left").write.mode("overwrite").json(path)


def compiled(rules: DataFrame, conditions: DataFrame) -> DataFrame:
    """(rule_set, rules): a row for each set, its rules in order with their clauses."""
    clauses = conditions.groupBy("rule_set", "rule", "clause").agg(F.collect_list(F.struct("field", "op", F.coalesce("negated", F.lit(False)).alias("negated"), "word", "low", "high")).alias("any_of"))
    clauses = clauses.groupBy("rule_set", "rule").agg(F.collect_list("any_of").alias("clauses"))
    rows = rules.join(clauses, ["rule_set", "rule"], "left").withColumn("clauses", F.coalesce("clauses", F.array().cast(clauses.schema["clauses"].dataType)))
    one = F.struct("turn", "rule", "choice", "weight", "per", "factor", "most", "reason", "clauses")
    return rows.groupBy("rule_set").agg(F.sort_array(F.collect_list(one)).alias("rules"))


def _fact(kind: str, value: Column) -> Column:
    """A fact as text and number; a list of words as its words between blanks, true as 1."""
    if kind.startswith("array"):
        text, number = F.array_join(value, " "), F.lit(None).cast("double")
    elif kind == "boolean":
        text, number = value.cast("string"), value.cast("double")
    elif kind == "string":
        text, number = value, F.lit(None).cast("double")
    else:
        text, number = value.cast("string"), value.cast("double")
    return F.struct(text.alias("text"), number.alias("number"))


def _holds(c: Column, facts: Column) -> Column:
    fact = facts[c["field"]]
    text, number, word = fact["text"], fact["number"], c["word"]
    quoted = F.concat(F.lit(r"(?U)(?<!\w)\Q"), word, F.lit(r"\E(?!\w)"))
    met = (
        F.when(c["op"] == "is", F.when(word.isNotNull(), text == word).otherwise(number == c["low"]))
        .when(c["op"] == "between", (number >= F.coalesce(c["low"], F.lit(float("-inf")))) & (number <= F.coalesce(c["high"], F.lit(float("inf")))))
        .when(c["op"] == "above", number > c["low"])
        .when(c["op"] == "below", number < c["high"])
        .when(c["op"] == "word", F.when(F.contains(text, word), F.regexp_like(text, quoted)).otherwise(False))
        .when(c["op"] == "has", F.contains(text, word))
        .when(c["op"] == "matches", F.regexp_like(text, word))
        .when(c["op"] == "present", text.isNotNull())
        .otherwise(F.raise_error(F.concat(F.lit("no condition "), F.coalesce(c["op"], F.lit("null")))).cast("boolean"))
    )
    return F.coalesce(met, F.lit(False)) != c["negated"]


def evaluate(subjects: DataFrame, rules: DataFrame, conditions: DataFrame, facts: Mapping[str, Column], rule_set: Column | None = None) -> DataFrame:
    """``subjects`` with ``fired`` (turn, rule, points, reason), ``points`` (their sum) and ``reasons`` (in order, nulls left out).

    ``facts`` names the columns that conditions ask about. A subject meets the rules of its ``rule_set`` and
    those of ``EVERY``; a null or unknown set has the latter only. A fact that a subject lacks meets no
    condition, but a negated one does hold for it. The rules come to the subjects by one join and are tried
    row by row, so subjects are never shuffled for them (while the rules are few enough to be sent around).
    Up to ``MOST_INLINE`` of them are columns of the subjects, so that patterns are compiled once, not in each row.
    Rules of equal turn come in order of name.
    """
    names = list(facts)
    kinds = dict(subjects.select(*(facts[n].alias(n) for n in names)).dtypes)
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(_fact(kinds[n], facts[n]) for n in names)))
    n = conditions.count() + rules.count()
    if n <= MOST_INLINE and conditions.filter(F.col("op").isNull() | ~F.col("op").isin(*OPS)).isEmpty():
        return _inline(subjects, rules.collect(), conditions.collect(), {k: _fact(kinds[k], facts[k]) for k in names}, rule_set)
    small = n <= MOST_BROADCAST
    sets = compiled(rules, conditions)
    common = sets.filter(F.col("rule_set") == EVERY).agg(F.first("rules").alias("_common"))  # one row, empty or not
    own = sets.filter(F.col("rule_set") != EVERY).select(F.col("rule_set").alias("_set"), F.col("rules").alias("_own"))
    rows = subjects.withColumn("_facts", known).withColumn("_set", (F.lit(None) if rule_set is None else rule_set).cast("string"))
    rows = rows.join(F.broadcast(own) if small else own.hint("merge"), "_set", "left").crossJoin(F.broadcast(common))
    none = F.array().cast(sets.schema["rules"].dataType)
    tried = F.array_sort(F.concat(F.coalesce("_common", none), F.coalesce("_own", none)))
    facts_of = F.col("_facts")
    held = F.filter(tried, lambda r: F.forall(r["clauses"], lambda any_of: F.exists(any_of, lambda c: _holds(c, facts_of))))
    rows = rows.withColumn("_held", held)
    first = F.filter("_held", lambda r, i: r["choice"].isNull() | ~F.exists(F.slice("_held", F.lit(1), i), lambda p: F.coalesce(p["choice"] == r["choice"], F.lit(False))))
    rows = rows.withColumn("_held", first)
    number = lambda r: facts_of[r["per"]]["number"]
    extra = lambda r: F.when(number(r).isNotNull(), r["factor"] * F.least(number(r), r["most"])).otherwise(0.0)
    fired = F.transform("_held", lambda r: F.struct(r["turn"].alias("turn"), r["rule"].alias("rule"), (r["weight"] + F.when(r["per"].isNotNull(), extra(r)).otherwise(0.0)).alias("points"), r["reason"].alias("reason")))
    rows = rows.withColumn("fired", fired)
    points = F.aggregate("fired", F.lit(0.0), lambda s, x: s + x["points"])
    reasons = F.filter(F.transform("fired", lambda x: x["reason"]), lambda x: x.isNotNull())
    return rows.withColumn("points", points).withColumn("reasons", reasons).drop("_facts", "_set", "_own", "_common", "_held")


def _met(c: Row, fact: Column) -> Column:
    """``_holds`` of a condition that is known beforehand."""
    text, number, word, low, high = fact["text"], fact["number"], c["word"], c["low"], c["high"]
    at = lambda x: F.lit(x).cast("double")
    met = {
        "is": lambda: text == F.lit(word) if word is not None else number == at(low),
        "between": lambda: (number >= at(float("-inf") if low is None else low)) & (number <= at(float("inf") if high is None else high)),
        "above": lambda: number > at(low),
        "below": lambda: number < at(high),
        "word": lambda: F.when(F.contains(text, F.lit(word)), F.regexp_like(text, F.lit(rf"(?U)(?<!\w)\Q{word}\E(?!\w)"))).otherwise(False),
        "has": lambda: F.contains(text, F.lit(word)),
        "matches": lambda: F.regexp_like(text, F.lit(word)),
        "present": lambda: text.isNotNull(),
    }[c["op"]]()
    met = F.coalesce(met, F.lit(False))
    return ~met if c["negated"] else met


def _inline(subjects: DataFrame, rules: list[Row], conditions: list[Row], facts: Mapping[str, Column], rule_set: Column | None) -> DataFrame:
    """``evaluate`` with few rules: each a column of whether it holds, and one array of those that count."""
    no_fact = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number"))
    of: dict[tuple, dict] = {}
    for c in conditions:
        of.setdefault((c["rule_set"], c["rule"]), {}).setdefault(c["clause"], []).append(_met(c, facts.get(c["field"], no_fact)))
    no_one = (False, "")
    rules = sorted((r for r in rules if r["rule_set"] is not None), key=lambda r: (r["turn"], r["rule"], no_one if r["choice"] is None else (True, r["choice"])))
    own = F.coalesce((F.lit(None) if rule_set is None else rule_set).cast("string"), F.lit(EVERY))
    held, points, fired = {}, {}, []
    for i, r in enumerate(rules):
        clauses = [reduce(lambda a, b: a | b, cs) for cs in of.get((r["rule_set"], r["rule"]), {}).values()]
        held[f"_h{i}"] = reduce(lambda a, b: a & b, clauses, F.lit(True) if r["rule_set"] == EVERY else own == F.lit(r["rule_set"]))
        extra = F.lit(0.0)
        if r["per"] is not None:
            number = facts.get(r["per"], no_fact)["number"]
            most = F.lit(r["most"]).cast("double")
            extra = F.when(number.isNotNull(), F.lit(r["factor"]).cast("double") * F.least(number, most)).otherwise(0.0)
        points[i] = F.lit(r["weight"]).cast("double") + extra
        before = [F.col(f"_h{j}") for j in range(i) if r["choice"] is not None and rules[j]["choice"] == r["choice"]]
        counts = reduce(lambda a, b: a & ~b, before, F.col(f"_h{i}"))
        fired.append(F.when(counts, F.struct(F.lit(r["turn"]).cast("int").alias("turn"), F.lit(r["rule"]).alias("rule"), points[i].alias("points"), F.lit(r["reason"]).cast("string").alias("reason"))))
    rows = subjects.withColumns(held) if held else subjects
    none = F.array().cast("array<struct<turn:int,rule:string,points:double,reason:string>>")
    rows = rows.withColumn("fired", F.array_compact(F.array(*fired)) if fired else none).drop(*held)
    total = F.aggregate("fired", F.lit(0.0), lambda s, x: s + x["points"])
    reasons = F.filter(F.transform("fired", lambda x: x["reason"]), lambda x: x.isNotNull())
    return rows.withColumn("points", total).withColumn("reasons", reasons)


def first_reason(subjects: DataFrame, rules: DataFrame, conditions: DataFrame, facts: Mapping[str, Column], name: str, default: str | None = None, rule_set: Column | None = None) -> DataFrame:
    """``subjects`` with ``name``: the reason of the first rule that holds, or ``default``."""
    rows = evaluate(subjects, rules, conditions, facts, rule_set)
    got = F.coalesce(F.get("reasons", F.lit(0)), F.lit(default).cast("string"))
    return rows.withColumn(name, got).drop("fired", "points", "reasons")
