"""Whole jobs beside narrower queries: full texts, many seeds, rule tables, both directions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.functions import text as T
from quillspark.operators import graphs as G
from quillspark.operators import retrieval as R
from quillspark.operators.cascade import contained
from quillspark.operators.rules import first_reason, rule, tables, when

from .graph_queries import EDGE_CTE, _edges
from .register import query
from .retrieval_queries import BM25_CTE, token_sql

FOLD_SQL = f"translate(lower({{}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"
_MARKS = r"(?m)^\s*(?:[0-9]+[.)]\s+|[a-z][)]\s+|[-]\s+)"


@query("documents", sql=rf"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, start // 630 AS i, substring(t, start + 1, 750) AS body FROM (SELECT doc_id, t, unnest(range(0, length(t), 630)) AS start FROM t)),
k AS (SELECT doc_id, i, trim(lower(regexp_replace(left(regexp_replace(body, '{_MARKS}', '', 'g'), 180), '\s+', ' ', 'g'))) AS key FROM c WHERE length(trim(body)) >= 60 AND length(regexp_replace(body, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(trim(body)) >= 0.25)
SELECT doc_id, i::BIGINT AS chunk_index, md5(key) AS key FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, key ORDER BY i) = 1""")
def g7_prefix_dedup_whole(docs):
    """Of a document's overlapping chunks that aren't noise, the first of those that begin alike: without list marks, in lower case, with single blanks, 180 characters."""
    flat = docs.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    chunks = flat.select("doc_id", F.explode(T.windows(F.col("text"))).alias("c")).select("doc_id", "c.chunk_index", "c.body")
    letters = F.length(F.regexp_replace("body", r"[^\p{L}\p{N}]", ""))
    chunks = chunks.filter((F.length(F.trim("body")) >= 60) & (letters / F.length(F.trim("body")) >= 0.25))
    key = F.trim(F.lower(F.regexp_replace(F.left(F.regexp_replace("body", _MARKS, ""), F.lit(180)), r"\s+", " ")))
    return chunks.groupBy("doc_id", F.md5(key).alias("key")).agg(F.min("chunk_index").alias("chunk_index")).select("doc_id", "chunk_index", "key")


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, t AS (SELECT item_id, bd.w AS c FROM bm JOIN bd USING (doc_id) WHERE rank = 1),
s AS (SELECT item_id, list_distinct([x for x in {token_sql("b.text")} if len(x) >= 3]) AS q, c FROM benchmark b JOIN t USING (item_id))
SELECT item_id, round(CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, list_distinct(c))) / len(q) END, 6) AS quality FROM s""")
def v15_context_quality_whole(docs, bench):
    """Part of a question's longer words that its best document's whole text holds."""
    top = R.with_documents(R.bm25(docs, bench, "doc_id", "item_id", 1), docs.select("doc_id", "text"), "doc_id").withColumn("c", T.tokens(F.col("text")))
    asked = bench.select("item_id", F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3).alias("q"))
    return asked.join(top, "item_id").select("item_id", F.round(T.overlap(F.col("q"), F.col("c")), 6).alias("quality"))


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE}, h AS (SELECT item_id, doc_id, rank, w FROM bm JOIN bd USING (doc_id) WHERE rank <= 10),
g AS (SELECT item_id, list_distinct(flatten(list(w))) AS c FROM h GROUP BY item_id),
s AS (SELECT item_id, list_distinct([x for x in {token_sql("b.text")} if len(x) >= 3]) AS q, c FROM benchmark b JOIN g USING (item_id)),
p AS (SELECT item_id, CASE WHEN len(q) = 0 THEN 1 ELSE len(list_intersect(q, c)) / len(q) END < 0.15 AS poor FROM s)
SELECT item_id, doc_id, rank, poor AS expanded FROM bm JOIN p USING (item_id) WHERE rank <= CASE WHEN poor THEN 20 ELSE 10 END""")
def v16_expansion_whole(docs, bench):
    """Ten hits; questions of which all ten together hold less than 15 in 100 of the longer words ask again, alone, for twenty."""
    hits = G.cut(R.bm25(docs, bench, "doc_id", "item_id", 10))
    texts = docs.join(G.cut(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    words = hits.join(texts.select("doc_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")), "doc_id").select("item_id", "word").distinct()
    asked = bench.select("item_id", F.explode_outer(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3))).alias("word"))
    met = asked.join(words.withColumn("met", F.lit(1)), ["item_id", "word"], "left").groupBy("item_id").agg(F.count("word").alias("n"), F.count("met").alias("m"))
    quality = met.join(hits.select("item_id").distinct(), "item_id").select("item_id", F.when(F.col("n") == 0, 1.0).otherwise(F.col("m") / F.col("n")).alias("quality"))
    poor = G.cut(quality.filter("quality < 0.15").select("item_id"))
    first = hits.join(poor, "item_id", "left_anti").select("item_id", "doc_id", "rank", F.lit(False).alias("expanded"))
    if poor.isEmpty():
        return first
    again = R.bm25(docs, bench.join(poor, "item_id", "left_semi"), "doc_id", "item_id", 20)
    return first.unionByName(again.select("item_id", "doc_id", "rank", F.lit(True).alias("expanded")))


#: Levels of a kind of place by time of day, in order; a kind not named, or a time outside its bands, has 0.2.
CROWD = [
    rule("canteen morning", 1, 0, "0.55", [when("kind", "is", "purchase")], [when("minute", "between", low=360, high=540)]),
    rule("canteen noon", 2, 0, "0.95", [when("kind", "is", "purchase")], [when("minute", "between", low=690, high=780)]),
    rule("canteen", 3, 0, "0.4", [when("kind", "is", "purchase")]),
    rule("library", 4, 0, "0.8", [when("kind", "is", "click")], [when("minute", "between", low=480, high=660), when("minute", "between", low=840, high=990)]),
    rule("library quiet", 5, 0, "0.3", [when("kind", "is", "click")]),
    rule("sport", 6, 0, "0.85", [when("kind", "is", "view")], [when("minute", "between", low=990, high=1110)]),
    rule("sport weekend", 7, 0, "0.7", [when("kind", "is", "view")], [when("weekend", "is", low=1)], [when("minute", "between", low=480, high=660)]),
]


@query("events", sql="""WITH e AS (SELECT event_id, event_type AS k, CASE WHEN event_id % 11 <> 0 THEN extract(hour FROM ts) * 60 + extract(minute FROM ts) END AS m, isodow(ts) >= 6 AS we, CASE WHEN event_id % 50 = 0 THEN greatest(0, least(1, value / 1000)) END AS live FROM events),
p AS (SELECT event_id, live, CASE WHEN live IS NOT NULL THEN live WHEN m IS NULL THEN 0 WHEN k = 'purchase' THEN CASE WHEN m BETWEEN 360 AND 540 THEN 0.55 WHEN m BETWEEN 690 AND 780 THEN 0.95 ELSE 0.4 END
  WHEN k = 'click' THEN CASE WHEN m BETWEEN 480 AND 660 OR m BETWEEN 840 AND 990 THEN 0.8 ELSE 0.3 END WHEN k = 'view' THEN CASE WHEN m BETWEEN 990 AND 1110 THEN 0.85 WHEN we AND m BETWEEN 480 AND 660 THEN 0.7 ELSE 0.2 END ELSE 0.2 END::DOUBLE AS level FROM e)
SELECT event_id, round(level, 6) AS level, CASE WHEN level >= 0.85 THEN 'packed' WHEN level >= 0.6 THEN 'busy' WHEN level >= 0.35 THEN 'moderate' ELSE 'quiet' END AS label, live IS NOT NULL AS live FROM p""")
def c13_crowd_forecast_whole(events):
    """The live level where there is one, else 0 for a time that can't be read (every eleventh), else that of the kind's band, of weekends too."""
    hhmm = F.when(F.col("event_id") % 11 == 0, "25:99").otherwise(F.date_format("ts", "HH:mm"))
    live = F.when(F.col("event_id") % 50 == 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value") / 1000)))
    rows = events.select("event_id", F.col("event_type").alias("kind"), S.minutes_of_day(hhmm).alias("minute"), S.is_weekend(F.col("ts")).alias("weekend"), live.alias("live_level"))
    out = first_reason(rows, *tables(events.sparkSession, CROWD), {c: F.col(c) for c in ("kind", "minute", "weekend")}, "band", "0.2")
    level = F.coalesce("live_level", F.when(F.col("minute").isNull(), 0.0).otherwise(F.col("band").cast("double")))
    return out.select("event_id", F.round(level, 6).alias("level"), S.crowd_label(level).alias("label"), F.col("live_level").isNotNull().alias("live"))


@query("orders", "lineitem", sql=f"""WITH RECURSIVE {EDGE_CTE}, r AS (SELECT 'c' || o_custkey AS seed, 'c' || o_custkey AS node, 0 AS hop FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 20 = 0) UNION SELECT r.seed, b.dst, r.hop + 1 FROM r JOIN b ON b.src = r.node WHERE r.hop < 3)
SELECT seed, node, min(hop)::BIGINT AS hop FROM r GROUP BY seed, node""")
def gr4_khop_whole(orders, lineitem):
    """What each customer whose number is divisible by 20 reaches in three hops, and in how many."""
    seeds = orders.filter("o_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).distinct()
    return G.k_hop_each(_edges(orders, lineitem), seeds, 3)


@query("orders", "lineitem")
def gr5_ppr_whole(orders, lineitem):
    """Personalised PageRank to convergence, from all customers whose number is divisible by 20."""
    seeds = orders.filter("o_custkey % 20 = 0").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("node")).distinct()
    return G.personal_pagerank(_edges(orders, lineitem), seeds).select("node", F.round("rank", 9).alias("rank")).filter("rank > 0")


@query("orders", sql="""WITH e AS (SELECT o_custkey AS u, o_orderkey % 1000 AS v, min(o_orderstatus) AS status FROM orders GROUP BY ALL), b AS (SELECT u, v, status FROM e UNION ALL SELECT v, u, status FROM e),
x AS (SELECT src, dst, min(status) AS status FROM (SELECT u AS src, v AS dst, status FROM b) GROUP BY ALL),
c AS (SELECT o_custkey AS u, o_orderkey % 1000 AS v, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'closed' ELSE 'repairing' END, o_orderkey) AS new, max(o_orderkey) AS k FROM orders WHERE o_orderkey % 5 = 0 GROUP BY ALL),
d AS (SELECT src, dst, arg_max(new, k) AS new FROM (SELECT u AS src, v AS dst, new, k FROM c UNION ALL SELECT v, u, new, k FROM c) GROUP BY ALL)
SELECT src, dst, coalesce(new, status) AS status FROM x LEFT JOIN d USING (src, dst)""")
def gr11_edge_update_whole(orders):
    """The status of every edge, in both directions, after the last report on it in either."""
    edges = orders.groupBy(F.col("o_custkey").alias("u"), (F.col("o_orderkey") % 1000).alias("v")).agg(F.min("o_orderstatus").alias("status"))
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "status").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "status")).groupBy("src", "dst").agg(F.min("status").alias("status"))
    reports = orders.filter("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst"), F.when(F.col("o_orderkey") % 3 == 0, "closed").otherwise("repairing").alias("new"), F.col("o_orderkey").alias("at"))
    return G.update_edges(both, reports)


@query("documents", sql="SELECT doc_id, CASE WHEN contains(lower(source), 'src1') THEN 'one' WHEN contains(lower(source), 'src7') THEN 'seven' WHEN contains(lower(text), ' und ') THEN 'german' WHEN contains(lower(text), ' que ') THEN 'romance' WHEN contains(lower(text), ' the ') THEN 'english' ELSE 'general' END AS kind FROM documents")
def s15_doc_type_whole(docs):
    """The kind of each document by its source's name first, then by its whole text: the first rule of a table that holds."""
    made = [rule(f"name {w}", i, 0, k, [when("name", "has", w)]) for i, (w, k) in enumerate((("src1", "one"), ("src7", "seven")))]
    made += [rule(f"text {w}", 10 + i, 0, k, [when("text", "has", w)]) for i, (w, k) in enumerate(((" und ", "german"), (" que ", "romance"), (" the ", "english")))]
    return first_reason(docs, *tables(docs.sparkSession, made), {"name": F.lower("source"), "text": F.lower("text")}, "kind", "general").select("doc_id", "kind")


@query("documents", sql="SELECT doc_id, md5(replace(strip_accents(lower(text)), 'đ', 'd')) AS bare FROM documents")
def s2_decomposed_fold(docs):
    """Texts in lower case, decomposed, without the marks U+0300 to U+036F, and đ as d."""
    return T.fold_marks(docs.select("doc_id", F.lower("text").alias("text")), "text").select("doc_id", F.md5("text").alias("bare"))


@query("events", sql="""SELECT event_id, to_json(map_from_entries([{'k': 'k', 'v': json_extract_string(props, '$.k')}, {'k': 'type', 'v': event_type}])) AS shown, 2::INTEGER AS hidden FROM events""")
def j3_hidden_fields(events):
    """What a profile shows of itself: the fields whose names don't begin with an underscore and that aren't the session."""
    profile = F.create_map(F.lit("_last"), F.col("ts").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"), F.lit("session_id"), F.col("user_id").cast("string"))
    shown = F.map_filter(profile, lambda k, v: ~F.startswith(k, F.lit("_")) & (k != "session_id"))
    return events.select("event_id", F.to_json(shown).alias("shown"), (F.size(profile) - F.size(shown)).alias("hidden"))


@query("lineitem", "part", "supplier", sql="""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_brand, 'unknown') AS tagline, CASE WHEN contains('near by: ' || coalesce(s_name, ''), coalesce(p_type, '')) OR p_type IS NULL THEN 'near by: ' || coalesce(s_name, '') ELSE 'near by: ' || coalesce(s_name, '') || ' · ' || p_type END AS reason
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 5 LEFT JOIN supplier ON l_suppkey = s_suppkey""")
def j4_enriched_lines(lineitem, part, supplier):
    """Order lines with what is known of part and supplier, or a default; a part's kind joins the reason unless it is in it."""
    rows = lineitem.join(part.filter("p_size > 5"), F.col("l_partkey") == F.col("p_partkey"), "left").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    reason = F.concat(F.lit("near by: "), F.coalesce("s_name", F.lit("")))
    whole = F.when(F.col("p_type").isNull() | F.contains(reason, F.col("p_type")), reason).otherwise(F.concat(reason, F.lit(" · "), "p_type"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("p_brand", F.lit("unknown")).alias("tagline"), whole.alias("reason"))


@query("conversations", "benchmark", sql=rf"""WITH t AS (SELECT conv_id, turn, regexp_replace(trim({FOLD_SQL.format('text')}), '[^\p{{L}}\p{{N}}_\s]', '', 'g') AS form FROM conversations WHERE role = 'user'),
w AS (SELECT DISTINCT item_id, x AS name FROM (SELECT item_id, unnest(regexp_split_to_array(regexp_replace(trim({FOLD_SQL.format('text')}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+')) AS x FROM benchmark) WHERE length(x) >= 9)
SELECT conv_id, turn, count(DISTINCT item_id) AS services, min(item_id) AS first_service FROM t JOIN w ON contains(form, name) GROUP BY conv_id, turn""")
def s40_service_match(chats, bench):
    """How many services each user turn names, a service being an item and its names the item's long words, and the first of them."""
    turns = chats.filter("role = 'user'").select(F.struct("conv_id", "turn").alias("at"), T.normalise(F.col("text")).alias("text"))
    names = bench.select("item_id", F.explode(F.array_distinct(F.filter(F.split(T.normalise(F.col("text")), r"\s+"), lambda x: F.length(x) >= 9))).alias("phrase"))
    met = contained(turns, "at", names).join(names, "phrase")
    return met.groupBy("at").agg(F.countDistinct("item_id").alias("services"), F.min("item_id").alias("first_service")).select("at.conv_id", "at.turn", "services", "first_service")


#: Rewrites of a question, in order: word and what stands for it.
REWRITES = (("the", "the, this"), ("und", "und, sowie"), ("que", "que, which"))
_WORD = r"[\p{L}\p{M}\p{N}_]"


@query("conversations", sql=rf"""SELECT conv_id, turn, list_sort(list_distinct([trim(text), array_to_string([CASE lower(x) {" ".join(f"WHEN '{w}' THEN '{r}'" for w, r in REWRITES)} ELSE x END for x in regexp_extract_all(trim(text), '{_WORD}+|[^{_WORD[1:]}+')], '')])) AS variants FROM conversations WHERE role = 'user'""")
def v23_question_variants(chats):
    """Each user turn and its rewrite by fixed rules, once if they are the same."""
    new = F.trim("text")
    for word, by in REWRITES:
        new = F.regexp_replace(new, rf"(?iU)\b{word}\b", by)
    return chats.filter("role = 'user'").select("conv_id", "turn", F.array_sort(F.array_distinct(F.array(F.trim("text"), new))).alias("variants"))


@query("events", sql="""WITH e AS (SELECT *, epoch_us(ts) AS us, CAST(json_extract(props, '$.k') AS BIGINT) AS tokens FROM events),
w AS (SELECT event_id, user_id, tokens, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap, count(*) OVER b AS calls, coalesce(sum(tokens) OVER b, 0)::BIGINT AS used, min(us) OVER b AS oldest, us FROM e WINDOW b AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND 1 PRECEDING))
SELECT event_id, user_id, calls, used, CASE WHEN gap < 60000000 THEN 'gap' WHEN calls >= 4 THEN 'calls' WHEN used + tokens > 0.8 * 200 AND used > 0 THEN 'tokens' ELSE 'go' END AS verdict, CASE WHEN calls > 0 THEN round((21600000000 - (us - oldest)) / 1e6, 6) END AS wait FROM w""")
def st3_quota_guard(events):
    """What a guard of calls, tokens and gaps says of each call: in the six hours before it four calls at most, four fifths of 200 tokens, a minute's pause; and when the oldest call leaves the window."""
    us, hours = F.unix_micros(F.col("ts").cast("timestamp")), 6 * 3600 * 1_000_000
    rows = events.select("event_id", "user_id", us.alias("us"), F.get_json_object("props", "$.k").cast("long").alias("tokens"))
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(-hours, -1)
    gap = F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    rows = rows.select("*", gap.alias("gap"), F.count("*").over(before).alias("calls"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("used"), F.min("us").over(before).alias("oldest"))
    verdict = F.when(F.col("gap") < 60_000_000, "gap").when(F.col("calls") >= 4, "calls").when((F.col("used") + F.col("tokens") > 0.8 * 200) & (F.col("used") > 0), "tokens").otherwise("go")
    wait = F.when(F.col("calls") > 0, F.round((hours - (F.col("us") - F.col("oldest"))) / 1e6, 6))
    return rows.select("event_id", "user_id", "calls", "used", verdict.alias("verdict"), wait.alias("wait"))
