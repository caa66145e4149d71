"""Queries of the rule engine: needs, personal boosts, time bands, guards. Rule tables are settings, given here."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.rules import evaluate, rule, tables, when

from .register import query

FOLD_SQL = f"translate(lower({{}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


def words(field: str, *ws: str) -> list[tuple]:
    """One of the whole words."""
    return [when(field, "word", w) for w in ws]


def word_sql(field: str, *ws: str) -> str:
    return "(" + " OR ".join(f"list_contains(string_split({field}, ' '), '{w}')" for w in ws) + ")"


def is_(field: str, *values: str) -> list[tuple]:
    return [when(field, "is", v) for v in values]


#: Boosts by role (a set each), style, interest, plan, charge, heat and light; a part's price and size stand for its measures.
BOOSTS = [
    rule("kind", 10, 5, None, is_("type", "PROMO"), rule_set="BUILDING"),
    rule("places", 11, 12, "near at hand", words("name", "ring", "rod", "gear"), rule_set="BUILDING"),
    rule("kind", 10, 20, "office", is_("type", "LARGE"), rule_set="MACHINERY"),
    rule("desk", 11, 15, "desk", words("name", "plate", "anvil"), rule_set="MACHINERY"),
    rule("shelf", 12, 8, None, words("name", "bolt"), rule_set="MACHINERY"),
    rule("kind", 10, 10, None, is_("type", "SMALL"), rule_set="HOUSEHOLD"),
    rule("guest", 11, 15, "guest", words("name", "hot", "cold"), rule_set="HOUSEHOLD"),
    rule("calm", 20, 12, "quiet", is_("style", "1-URGENT"), [when("size", "between", high=15)], choice="noise"),
    rule("loud", 21, -15, None, is_("style", "1-URGENT"), [when("size", "between", low=35)], choice="noise"),
    rule("alone", 22, 10, None, is_("style", "1-URGENT"), words("name", "new", "old")),
    rule("group", 23, 10, "together", is_("style", "5-LOW"), [when("size", "between", low=20, high=30), when("price", "between", low=1000)]),
    rule("hall", 24, 8, None, is_("style", "5-LOW"), words("name", "large", "blue")),
    rule("gadgets", 30, 25, "likes gadgets", is_("interest", "R"), words("name", "widget", "gizmo")),
    rule("colours", 31, 20, "likes colour", is_("interest", "A"), words("name", "red", "hot")),
    rule("planned", 40, 35, "planned", [when("quantity", "is", low=50)], choice="plan"),
    rule("support", 41, 12, "support", [when("quantity", "between", low=45)], words("name", "bolt", "rod", "new"), choice="plan"),
    rule("charge", 50, 18, "charge", [when("balance", "below", high=0)], is_("type", "SMALL"), [when("size", "above", low=10)]),
    rule("cool", 60, 12, "cool", [when("price", "above", low=950)], is_("type", "ECONOMY"), choice="heat"),
    rule("heat", 61, -20, "heat", [when("price", "above", low=950)], [when("type", "is", "STANDARD", negated=True), when("name", "word", "plate")], choice="heat"),
    rule("shade", 70, 8, "shade", [when("discount", "above", low=0.05)], is_("type", "STANDARD"), choice="light"),
    rule("light", 71, -15, None, [when("discount", "above", low=0.05)], choice="light"),
    rule("room", 80, 0, None, per="size", factor=0.125, most=40),
]
_W = lambda *ws: word_sql("p_name", *ws)


@query("lineitem", "orders", "customer", "part", sql=f"""WITH x AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [
  CASE WHEN c_mktsegment = 'BUILDING' AND p_type = 'PROMO' THEN 5 WHEN c_mktsegment = 'MACHINERY' AND p_type = 'LARGE' THEN 20 WHEN c_mktsegment = 'HOUSEHOLD' AND p_type = 'SMALL' THEN 10 END,
  CASE WHEN c_mktsegment = 'BUILDING' AND {_W("ring", "rod", "gear")} THEN 12 WHEN c_mktsegment IN ('MACHINERY') AND {_W("plate", "anvil")} THEN 15 WHEN c_mktsegment = 'HOUSEHOLD' AND {_W("hot", "cold")} THEN 15 END,
  CASE WHEN c_mktsegment = 'MACHINERY' AND {_W("bolt")} THEN 8 END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN p_size <= 15 THEN 12 WHEN p_size >= 35 THEN -15 ELSE 0 END END,
  CASE WHEN o_orderpriority = '1-URGENT' AND {_W("new", "old")} THEN 10 END,
  CASE WHEN o_orderpriority = '5-LOW' AND (p_size BETWEEN 20 AND 30 OR p_retailprice >= 1000) THEN 10 END,
  CASE WHEN o_orderpriority = '5-LOW' AND {_W("large", "blue")} THEN 8 END,
  CASE WHEN l_returnflag = 'R' AND {_W("widget", "gizmo")} THEN 25 END,
  CASE WHEN l_returnflag = 'A' AND {_W("red", "hot")} THEN 20 END,
  CASE WHEN l_quantity = 50 THEN 35 WHEN l_quantity >= 45 AND {_W("bolt", "rod", "new")} THEN 12 END,
  CASE WHEN c_acctbal < 0 AND p_type = 'SMALL' AND p_size > 10 THEN 18 END,
  CASE WHEN p_retailprice > 950 THEN CASE WHEN p_type = 'ECONOMY' THEN 12 WHEN p_type <> 'STANDARD' OR {_W("plate")} THEN -20 END END,
  CASE WHEN l_discount > 0.05 THEN CASE WHEN p_type = 'STANDARD' THEN 8 ELSE -15 END END,
  0.125::DOUBLE * least(p_size, 40)] AS pts,
  concat_ws('; ',
   CASE WHEN c_mktsegment = 'MACHINERY' AND p_type = 'LARGE' THEN 'office' END,
   CASE WHEN c_mktsegment = 'BUILDING' AND {_W("ring", "rod", "gear")} THEN 'near at hand' WHEN c_mktsegment = 'MACHINERY' AND {_W("plate", "anvil")} THEN 'desk' WHEN c_mktsegment = 'HOUSEHOLD' AND {_W("hot", "cold")} THEN 'guest' END,
   CASE WHEN o_orderpriority = '1-URGENT' AND p_size <= 15 THEN 'quiet' END,
   CASE WHEN o_orderpriority = '5-LOW' AND (p_size BETWEEN 20 AND 30 OR p_retailprice >= 1000) THEN 'together' END,
   CASE WHEN l_returnflag = 'R' AND {_W("widget", "gizmo")} THEN 'likes gadgets' END,
   CASE WHEN l_returnflag = 'A' AND {_W("red", "hot")} THEN 'likes colour' END,
   CASE WHEN l_quantity = 50 THEN 'planned' WHEN l_quantity >= 45 AND {_W("bolt", "rod", "new")} THEN 'support' END,
   CASE WHEN c_acctbal < 0 AND p_type = 'SMALL' AND p_size > 10 THEN 'charge' END,
   CASE WHEN p_retailprice > 950 THEN CASE WHEN p_type = 'ECONOMY' THEN 'cool' WHEN p_type <> 'STANDARD' OR {_W("plate")} THEN 'heat' END END,
   CASE WHEN l_discount > 0.05 AND p_type = 'STANDARD' THEN 'shade' END) AS reasons FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(list_sum([coalesce(p, 0)::DOUBLE for p in pts]), 6) AS points, reasons FROM b""")
def s38_personal_boosts(lineitem, orders, customer, part):
    """What each order line gains for its customer: rules by role (a set each) and for everyone, summed, with reasons."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    facts = {"type": "p_type", "name": "p_name", "size": "p_size", "price": "p_retailprice", "style": "o_orderpriority", "interest": "l_returnflag", "quantity": "l_quantity", "balance": "c_acctbal", "discount": "l_discount"}
    out = evaluate(rows, *tables(lineitem.sparkSession, BOOSTS), {k: F.col(v) for k, v in facts.items()}, F.col("c_mktsegment"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("points", 6).alias("points"), F.array_join("reasons", "; ").alias("reasons"))


#: Words that show a need, in the folded text of a turn.
NEEDS = [
    rule("calm", 1, 1, "calm", [when("text", "has", w) for w in ("schst", "with", "dans", "bien")]),
    rule("table", 2, 1, "table", [when("text", "has", w) for w in ("tion", "keit", "ment")]),
    rule("food", 3, 1, "food", [when("text", "has", w) for w in ("eat", "ess", "mange", "comer")]),
    rule("rest", 4, 1, "rest", [when("text", "word", w) for w in ("the", "die", "la")]),
]


@query("conversations", sql=f"""WITH t AS (SELECT conv_id, turn, role, {FOLD_SQL.format('text')} AS f FROM conversations WHERE role = 'user')
SELECT conv_id, turn, concat_ws(',', CASE WHEN contains(f, 'schst') OR contains(f, 'with') OR contains(f, 'dans') OR contains(f, 'bien') THEN 'calm' END, CASE WHEN contains(f, 'tion') OR contains(f, 'keit') OR contains(f, 'ment') THEN 'table' END,
  CASE WHEN contains(f, 'eat') OR contains(f, 'ess') OR contains(f, 'mange') OR contains(f, 'comer') THEN 'food' END,
  CASE WHEN regexp_matches(f, '(^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])(the|die|la)($|[^\\p{{L}}\\p{{N}}\\p{{M}}_])') THEN 'rest' END) AS needs FROM t""")
def s37_need_flags(chats):
    """The needs that each user turn's words show, by a rule table over its folded text."""
    out = evaluate(chats.filter("role = 'user'"), *tables(chats.sparkSession, NEEDS), {"text": T.fold(F.col("text"))})
    return out.select("conv_id", "turn", F.array_join("reasons", ",").alias("needs"))


def _any_need() -> list[tuple]:
    return [when(n, "is", low=1) for n in ("ac", "quiet", "tables", "food", "sport", "rest")]


def _need(name: str, turn: int, weight: float, need: str, *clauses, **more):
    return rule(name, turn, weight, need, [when(need, "is", low=1)], *clauses, **more)


#: What a place's features are worth for the needs of a request; nothing without a need.
NEED_SCORES = [
    _need("cooled", 1, 15, "ac", [when("cooled", "is", low=1)]),
    _need("warm", 2, -15, "ac", [when("cooled", "is", low=1, negated=True)]),
    _need("seats", 3, 10, "tables", [when("seats", "is", low=1)]),
    _need("bare", 4, -10, "tables", [when("seats", "is", low=1, negated=True)]),
    _need("still", 5, 15, "quiet", [when("noise", "between", high=0.3)], choice="noise"),
    _need("noisy", 6, -20, "quiet", [when("noise", "between", low=0.7)], choice="noise"),
    _need("middling", 7, 10, "quiet", choice="noise", per="noise", factor=-10.0, most=1.0),
    _need("lounge", 8, 25, "rest", words("name", "new", "large")),
    _need("hushed", 9, 5, "rest", [when("noise", "between", high=0.3)]),
    _need("fresh", 10, 5, "rest", [when("cooled", "is", low=1)]),
    _need("kitchen", 11, 30, "food", words("name", "hot", "plate"), choice="food"),
    _need("no kitchen", 12, -30, "food", choice="food"),
    _need("court", 13, 30, "sport", words("name", "ring", "rod", "anvil"), choice="sport"),
    _need("no court", 14, -30, "sport", choice="sport"),
    rule("room", 15, 0, None, _any_need(), per="capacity", factor=0.005, most=1000.0),
]


@query("lineitem", "orders", "part", sql=f"""WITH x AS (SELECT *, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS ac, o_orderpriority = '2-HIGH' AS quiet, o_orderpriority IN ('2-HIGH', '3-MEDIUM') AS tables, o_orderpriority = '5-LOW' AS food,
  o_orderpriority = '4-NOT SPECIFIED' AND l_returnflag = 'R' AS sport, l_returnflag = 'N' AND l_linenumber % 2 = 0 AS rest, p_type IN ('ECONOMY', 'PROMO') AS cooled, p_size % 2 = 0 AS seats, p_size / 50.0::DOUBLE AS noise
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ac OR quiet OR tables OR food OR sport OR rest THEN round(
  CASE WHEN ac THEN CASE WHEN cooled THEN 15 ELSE -15 END ELSE 0 END + CASE WHEN tables THEN CASE WHEN seats THEN 10 ELSE -10 END ELSE 0 END
  + CASE WHEN quiet THEN CASE WHEN noise <= 0.3 THEN 15 WHEN noise >= 0.7 THEN -20 ELSE (1 - noise) * 10 END ELSE 0 END
  + CASE WHEN rest THEN CASE WHEN {_W("new", "large")} THEN 25 ELSE 0 END + CASE WHEN noise <= 0.3 THEN 5 ELSE 0 END + CASE WHEN cooled THEN 5 ELSE 0 END ELSE 0 END
  + CASE WHEN food THEN CASE WHEN {_W("hot", "plate")} THEN 30 ELSE -30 END ELSE 0 END + CASE WHEN sport THEN CASE WHEN {_W("ring", "rod", "anvil")} THEN 30 ELSE -30 END ELSE 0 END
  + least(p_retailprice, 1000) / 1000 * 5, 6)::DOUBLE ELSE 0.0::DOUBLE END AS score FROM x""")
def s37_need_scores(lineitem, orders, part):
    """The score of each order line's part for the needs of its order."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    priority, flag = F.col("o_orderpriority"), F.col("l_returnflag")
    facts = {
        "ac": (F.col("o_orderstatus") == "F") | (priority == "1-URGENT"),
        "quiet": priority == "2-HIGH",
        "tables": priority.isin("2-HIGH", "3-MEDIUM"),
        "food": priority == "5-LOW",
        "sport": (priority == "4-NOT SPECIFIED") & (flag == "R"),
        "rest": (flag == "N") & (F.col("l_linenumber") % 2 == 0),
        "cooled": F.col("p_type").isin("ECONOMY", "PROMO"),
        "seats": F.col("p_size") % 2 == 0,
        "noise": F.col("p_size") / 50,
        "name": F.col("p_name"),
        "capacity": F.col("p_retailprice"),
    }
    out = evaluate(rows, *tables(lineitem.sparkSession, NEED_SCORES), facts)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("points", 6).alias("score"))


#: Points of a category by band of the day, on weekends, under a roof, by tone of its reviews and by what is known of it.
BANDS = [
    rule("morning", 1, 12, "morning", is_("category", "signup", "view"), [when("hour", "between", low=7, high=9)]),
    rule("noon", 2, 18, "noon", is_("category", "purchase"), [when("hour", "between", low=11, high=13)]),
    rule("noon crowd", 3, -6, None, is_("category", "error"), [when("hour", "between", low=11, high=13)]),
    rule("evening", 4, 10, "evening", is_("category", "click", "view"), [when("hour", "between", low=17, high=21)]),
    rule("weekend", 5, 6, "weekend", is_("category", "click"), [when("weekend", "is", low=1)], choice="week"),
    rule("weekend shut", 6, -8, None, is_("category", "purchase"), [when("weekend", "is", low=1)], choice="week"),
    rule("weekday", 7, 2, None, is_("category", "purchase"), choice="week"),
    rule("good tone", 8, 4, "liked", [when("tone", "above", low=100)], choice="tone"),
    rule("bad tone", 9, -4, None, [when("tone", "below", high=5)], choice="tone"),
    rule("known", 10, 0, None, [when("known", "present")], per="known", factor=0.25, most=60.0),
]


@query("events", sql="""WITH e AS (SELECT event_id, user_id, event_type AS c, extract(hour FROM ts) AS h, isodow(ts) >= 6 AS we, value AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT user_id, count(*) AS n, round(sum(CASE WHEN c IN ('signup', 'view') AND h BETWEEN 7 AND 9 THEN 12 ELSE 0 END + CASE WHEN h BETWEEN 11 AND 13 THEN CASE c WHEN 'purchase' THEN 18 WHEN 'error' THEN -6 ELSE 0 END ELSE 0 END
  + CASE WHEN c IN ('click', 'view') AND h BETWEEN 17 AND 21 THEN 10 ELSE 0 END + CASE WHEN c = 'click' AND we THEN 6 WHEN c = 'purchase' AND we THEN -8 WHEN c = 'purchase' THEN 2 ELSE 0 END
  + CASE WHEN v > 100 THEN 4 WHEN v < 5 THEN -4 ELSE 0 END + coalesce(0.25::DOUBLE * least(k, 60), 0)), 6) AS points,
  sum(CASE WHEN c = 'purchase' AND h BETWEEN 11 AND 13 THEN 1 ELSE 0 END)::BIGINT AS at_noon FROM e GROUP BY user_id""")
def s39_time_boosts(events):
    """Each user's points from what categories are worth at their time of day and week, by tone and by what is known."""
    facts = {"category": F.col("event_type"), "hour": F.hour("ts"), "weekend": F.weekday("ts") >= 5, "tone": F.col("value"), "known": F.get_json_object("props", "$.k").cast("long")}
    rows = evaluate(events, *tables(events.sparkSession, BANDS), facts)
    noon = F.array_contains("reasons", "noon").cast("long")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("points"), 6).alias("points"), F.sum(noon).alias("at_noon"))


#: What a guard does with a text, the first rule that holds: too long, an order to drop its instructions, a keyword written apart, markup only, harsh words.
GUARD = [
    rule("length", 1, 0, "block: too long", [when("length", "above", low=1200)], choice="action"),
    rule("override", 2, 0, "block: override", [when("folded", "matches", r"\b(ignore|forget)\b.{0,40}\b(rules|instructions)\b"), when("folded", "matches", r"\bthe [a-z]{0,12}tion\b")], choice="action"),
    rule("apart", 3, 0, "block: apart", [when("compact", "has", w) for w in ("jailbreak", "developermode", "thein")], choice="action"),
    rule("empty", 4, 0, "block: empty", [when("left", "is", "")], choice="action"),
    rule("harsh", 5, 0, "warn: harsh", [when("folded", "word", w) for w in ("worthless", "stupid", "scum")], choice="action"),
    rule("fine", 6, 0, "allow", choice="action"),
]
_LEFT = r"trim(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '<[^>]{1,200}>', ' ', 'g'), '[ ]{3,}', '  ', 'g'))"


@query("conversations", sql=rf"""WITH t AS (SELECT conv_id, turn, role, text, {FOLD_SQL.format("text")} AS f, {_LEFT} AS l FROM conversations)
SELECT conv_id, turn, role, CASE WHEN length(text) > 1200 THEN 'block: too long' WHEN regexp_matches(f, '\b(ignore|forget)\b.{{0,40}}\b(rules|instructions)\b') OR regexp_matches(f, '\bthe [a-z]{{0,12}}tion\b') THEN 'block: override'
  WHEN contains(regexp_replace(f, '\s', '', 'g'), 'jailbreak') OR contains(regexp_replace(f, '\s', '', 'g'), 'developermode') OR contains(regexp_replace(f, '\s', '', 'g'), 'thein') THEN 'block: apart'
  WHEN l = '' THEN 'block: empty' WHEN regexp_matches(f, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])(worthless|stupid|scum)($|[^\p{{L}}\p{{N}}\p{{M}}_])') THEN 'warn: harsh' ELSE 'allow' END AS verdict,
  CASE WHEN verdict LIKE 'block%' THEN NULL ELSE md5(l) END AS passed FROM t""")
def f4_guard_cascade(chats):
    """What an input guard says of every turn, and a digest of the sanitised text that it lets through."""
    folded, left = T.fold(F.col("text")), T.sanitise(F.col("text"))
    facts = {"length": F.length("text"), "folded": folded, "compact": F.regexp_replace(folded, r"\s", ""), "left": left}
    out = evaluate(chats, *tables(chats.sparkSession, GUARD), facts).withColumn("verdict", F.get("reasons", F.lit(0)))
    return out.select("conv_id", "turn", "role", "verdict", F.when(~F.startswith("verdict", F.lit("block")), F.md5(left)).alias("passed"))
