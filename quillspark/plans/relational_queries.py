"""Relational queries on the star schema and the events: joins, aggregates, windows, sets, ordering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scores as S
from quillspark.operators.retrieval import top_k
from quillspark.operators.rules import evaluate, rule, tables, when

from .register import query


@query("orders", "customer", sql="SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def n1_inner(orders, customer):
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("customer", "orders", sql="SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def n2_left(customer, orders):
    n = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("supplier", "customer", sql="""SELECT coalesce(s.k, c.k) AS k, coalesce(s.n, 0)::BIGINT AS n_suppliers, coalesce(c.n, 0)::BIGINT AS n_customers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.k = c.k""")
def n3_full(supplier, customer):
    s = supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_s"))
    c = customer.filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_c"))
    return s.join(c, "k", "full").select("k", F.coalesce("n_s", F.lit(0)).cast("long").alias("n_suppliers"), F.coalesce("n_c", F.lit(0)).cast("long").alias("n_customers"))


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def n4_semi(customer, orders):
    return customer.join(orders.filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("customer", "orders", sql="SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def n5_anti(customer, orders):
    return customer.join(orders.filter("o_totalprice > 300000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


@query("lineitem", sql="""WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_partkey AS a, y.l_partkey AS b, count(*)::BIGINT AS n FROM l x JOIN l y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL HAVING count(*) >= 2""")
def n6_cooccurrence(lineitem):
    """Parts that two orders or more have together; an order has few lines."""
    one = lineitem.select("l_orderkey", "l_partkey").distinct()
    a, b = one.toDF("k", "a"), one.toDF("k", "b")
    return a.join(b, "k").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).filter("n >= 2")


#: Bands of the day in order: name, first and last minute. They overlap; the first that holds counts.
BANDS = (("early", 300, 540), ("morning", 540, 690), ("lunch", 660, 840), ("evening", 1020, 1260))


@query("events", sql="WITH m AS (SELECT hour(ts) * 60 + minute(ts) AS m FROM events) SELECT CASE " + " ".join(f"WHEN m BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in BANDS) + " ELSE 'afternoon' END AS band, count(*)::BIGINT AS n FROM m GROUP BY 1")
def n8_time_band(events):
    m = F.hour("ts") * 60 + F.minute("ts")
    band = F.lit("afternoon")
    for name, a, b in reversed(BANDS):
        band = F.when(m.between(a, b), name).otherwise(band)
    return events.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query("part", sql="WITH k(word, ord) AS (VALUES ('ring', 1), ('small', 2), ('red', 3)) SELECT p_partkey, arg_min(word, ord) AS word FROM part JOIN k ON contains(p_name, word) GROUP BY p_partkey")
def n9_containment(part):
    """The first keyword that a name contains; keywords are a small fixed rule table."""
    rules = part.sparkSession.createDataFrame([("ring", 1), ("small", 2), ("red", 3)], "word string, ord int")
    return part.join(F.broadcast(rules), F.contains("p_name", "word")).groupBy("p_partkey").agg(F.min_by("word", "ord").alias("word"))


@query("events", sql="""WITH s AS (SELECT user_id, event_type, max(event_id) AS event_id, CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS p FROM events GROUP BY ALL)
SELECT user_id, event_type, event_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p, event_id DESC) = 1""")
def n10_priority_merge(events):
    """One row a user: from purchases if there is one, else the latest of the others."""
    p = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    return events.groupBy("user_id").agg(F.min_by(F.struct("event_type", "event_id"), F.struct(p, -F.col("event_id"))).alias("x")).select("user_id", "x.*")


@query("documents", sql=r"SELECT doc_id, count(*)::BIGINT AS n_lines, max(length(line))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def n13_lateral_lines(docs):
    return docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).cast("long").alias("longest"))


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, round(stddev_samp(l_discount), 6) AS std FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL")
def a3_summary(lineitem):
    rows = lineitem.filter("l_shipdate <= TIMESTAMP '2000-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_extendedprice"), 4).alias("price"), F.round(F.stddev_samp("l_discount"), 6).alias("std"))


@query("lineitem", sql="SELECT l_partkey, round((3.0 * 5 + sum(1 + l_linenumber % 5)) / (5 + count(*)), 2) AS avg_rating, count(*)::BIGINT AS n FROM lineitem GROUP BY l_partkey")
def a7_prior_average(lineitem):
    """Mean rating with five prior votes of 3."""
    return lineitem.groupBy("l_partkey").agg(F.round((15.0 + F.sum(1 + F.col("l_linenumber") % 5)) / (5 + F.count("*")), 2).alias("avg_rating"), F.count("*").alias("n"))


@query("events", sql="SELECT user_id, count(*) FILTER (event_type = 'view')::BIGINT AS views, count(*) FILTER (event_type = 'purchase')::BIGINT AS buys, round(avg(value) FILTER (event_type = 'purchase'), 7) AS spend, bool_or(event_type = 'error') AS failed FROM events GROUP BY user_id")
def a8_conditional_stats(events):
    kind = F.col("event_type")
    return events.groupBy("user_id").agg(F.count(F.when(kind == "view", 1)).alias("views"), F.count(F.when(kind == "purchase", 1)).alias("buys"), F.round(F.avg(F.when(kind == "purchase", F.col("value"))), 7).alias("spend"), F.bool_or(kind == "error").alias("failed"))


@query("orders", sql="SELECT o_custkey, o_orderpriority AS p FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1")
def a12_majority(orders):
    n = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("p"))


@query("events", sql="SELECT min(value) AS lo, max(value) AS hi, min(ts) AS first_ts, max(ts) AS last_ts FROM events")
def a14_bounds(events):
    return events.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("lineitem", sql="SELECT l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_orderkey")
def a16_upper_median(lineitem):
    q = F.array_sort(F.collect_list("l_quantity"))
    return lineitem.groupBy("l_orderkey").agg(F.element_at(q, (F.floor(F.count("*") / 2) + 1).cast("int")).alias("upper_median"))


@query("lineitem", sql="SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS grp, count(*)::BIGINT AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def a17_cube(lineitem):
    return lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("grp"), F.count("*").alias("n"))


@query("documents", sql="SELECT source, list_sort(list(doc_id))[1:5] AS first_docs, count(*)::BIGINT AS n FROM documents GROUP BY source")
def a1_group_collect(docs):
    """The first documents of each source: ranked in each partition first, so no whole group is gathered."""
    return top_k(docs.select("source", "doc_id", F.lit(0).alias("score")), "source", "doc_id", 5).groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("first_docs")).join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")


@query("orders", sql="SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders")
def w1_rank(orders):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("pos"))


@query("orders", sql="SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders")
def w4_share(orders):
    return orders.select("o_orderkey", F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 6).alias("share"))


@query("documents", sql=r"WITH l AS (SELECT doc_id, lag(list_distinct(string_split(left(text, 200), ' '))) OVER (PARTITION BY source ORDER BY doc_id) AS p, list_distinct(string_split(left(text, 200), ' ')) AS w FROM documents) SELECT doc_id, len(list_intersect(w, p))::BIGINT AS shared FROM l WHERE p IS NOT NULL")
def w6_lag_overlap(docs):
    words = F.split(F.left("text", F.lit(200)), " ")
    before = F.lag("w").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = docs.select("doc_id", "source", words.alias("w")).withColumn("p", before).filter("p IS NOT NULL")
    return rows.select("doc_id", F.size(F.array_intersect("w", "p")).cast("long").alias("shared"))


@query("documents", sql=r"WITH l AS (SELECT doc_id, lag(list_distinct(string_split(right(text, 150), ' '))) OVER (PARTITION BY source ORDER BY doc_id) AS p, list_distinct(string_split(left(text, 150), ' ')) AS w FROM documents) SELECT doc_id, len(list_intersect(w, p))::BIGINT AS shared FROM l WHERE p IS NOT NULL")
def w6_lag_overlap_whole(docs):
    """Words that a document's head shares with the tail of the one before it."""
    words = lambda f: F.split(f("text", F.lit(150)), " ")
    before = F.lag("tail").over(Window.partitionBy("source").orderBy("doc_id"))
    rows = docs.select("doc_id", "source", words(F.right).alias("tail"), words(F.left).alias("head")).withColumn("p", before).filter("p IS NOT NULL")
    return rows.select("doc_id", F.size(F.array_intersect("head", "p")).cast("long").alias("shared"))


@query("orders", sql="""SELECT o_custkey, o_orderkey, 'top' AS side FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5
UNION ALL SELECT o_custkey, o_orderkey, 'bottom' FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey DESC) <= 5""")
def w8_top_bottom(orders):
    top = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    low = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", F.desc("o_orderkey")))
    rows = orders.withColumn("t", top).withColumn("b", low)
    sides = F.array_compact(F.array(F.when(F.col("t") <= 5, F.lit("top")), F.when(F.col("b") <= 5, F.lit("bottom"))))
    return rows.select("o_custkey", "o_orderkey", F.explode(sides).alias("side"))


@query("events", sql="SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY value, event_id) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value), 6) AS pr FROM events")
def w10_ntile(events):
    w = Window.partitionBy("user_id")
    return events.select("event_id", F.ntile(4).over(w.orderBy("value", "event_id")).cast("long").alias("quarter"), F.round(F.percent_rank().over(w.orderBy("value")), 6).alias("pr"))


@query("orders", sql="SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o1_top_orders(orders):
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("events", sql="SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def o4_bounded_history(events):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).filter("r <= 20").select("user_id", "event_id")


@query("benchmark", sql="SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def o5_offset_limit(bench):
    return bench.orderBy("item_id").offset(5).limit(10).select("item_id")


@query("supplier", "nation", sql="""WITH p AS (SELECT s_suppkey, 10 + s_suppkey % 17 / 100.0 AS lat, 106 + s_suppkey % 23 / 100.0 AS lon FROM supplier),
q AS (SELECT n_nationkey, 10 + n_nationkey / 150.0 AS lat, 106 + n_nationkey / 110.0 AS lon FROM nation),
d AS (SELECT s_suppkey, n_nationkey, round(2 * 6371000 * atan2(sqrt(h), sqrt(1 - h)), 3) AS metres FROM (SELECT s_suppkey, n_nationkey, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2) AS h FROM p, q))
SELECT s_suppkey, arg_min(n_nationkey, struct_pack(m := metres, n := n_nationkey)) AS nearest, min(metres) AS metres FROM d GROUP BY s_suppkey""")
def o6_nearest_place(supplier, nation):
    """The nearest of a few fixed places (a row a nation) by great-circle distance."""
    p = supplier.select("s_suppkey", (10 + F.col("s_suppkey") % 17 / 100.0).alias("lat"), (106 + F.col("s_suppkey") % 23 / 100.0).alias("lon"))
    places = nation.select(F.collect_list(F.struct("n_nationkey", (10 + F.col("n_nationkey") / 150.0).alias("lat"), (106 + F.col("n_nationkey") / 110.0).alias("lon"))).alias("places"))
    rows = p.crossJoin(F.broadcast(places))  # places is one row
    metres = F.transform("places", lambda x: F.struct(F.round(S.haversine(F.col("lat"), F.col("lon"), x.lat, x.lon), 3).alias("m"), x.n_nationkey.alias("n")))
    return rows.withColumn("best", F.array_min(metres)).select("s_suppkey", F.col("best.n").alias("nearest"), F.col("best.m").alias("metres"))


@query("supplier", "customer", sql="SELECT s_nationkey AS k, 's' AS side FROM supplier UNION ALL SELECT c_nationkey, 'c' FROM customer")
def u1_union_all(supplier, customer):
    return supplier.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side")).unionByName(customer.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")))


@query("supplier", "customer", sql="SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def u2_union(supplier, customer):
    return supplier.select(F.col("s_nationkey").alias("k")).union(customer.select("c_nationkey")).distinct()


@query("documents", "benchmark", sql="SELECT item_id, len(list_intersect(list_distinct(string_split(b.text, ' ')), list_distinct(string_split(d.text, ' '))))::BIGINT AS n FROM benchmark b JOIN documents d ON d.doc_id = item_id")
def u3_overlap_size(docs, bench):
    rows = bench.join(docs.select(F.col("doc_id").alias("item_id"), F.col("text").alias("t")), "item_id")
    return rows.select("item_id", F.size(F.array_intersect(F.split("text", " "), F.split("t", " "))).cast("long").alias("n"))


@query("orders", sql="(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def u4_except_all(orders):
    return orders.filter("o_orderstatus = 'F'").select("o_custkey").exceptAll(orders.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("orders", sql="(SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') INTERSECT ALL (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def u5_intersect_all(orders):
    return orders.filter("o_orderstatus = 'F'").select("o_custkey").intersectAll(orders.filter("o_orderstatus = 'O'").select("o_custkey"))


@query("customer", sql="SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'guest' ELSE 'user ' || split_part(c_name, '#', 2) END AS shown FROM customer")
def j5_display_name(customer):
    return customer.select("c_custkey", F.when(F.col("c_acctbal") < 0, "guest").otherwise(F.concat(F.lit("user "), F.split_part("c_name", F.lit("#"), F.lit(2)))).alias("shown"))


@query("part", sql="SELECT p_partkey, [CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, least(p_retailprice / 1000, 1.0)::DOUBLE, CASE WHEN p_type = 'ECONOMY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END] AS features FROM part")
def j6_feature_vector(part):
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return part.select("p_partkey", F.array(flag(F.col("p_size") > 25), F.least(F.col("p_retailprice") / 1000, F.lit(1.0)), flag(F.col("p_type") == "ECONOMY")).alias("features"))


@query("events", sql="SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def g9_json_field(events):
    return events.select("event_id", F.from_json("props", "k long")["k"].alias("k")).filter("k > 50")


@query("lineitem", sql="""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN q <= 10 THEN 30.0 WHEN q <= 25 THEN round(30 - 20 * (q - 10) / 15, 6) WHEN q <= 40 THEN round(10 - 10 * (q - 25) / 15, 6) ELSE -5.0 END::DOUBLE AS pts
FROM (SELECT *, l_quantity AS q FROM lineitem)""")
def s20_proximity(lineitem):
    """Points by distance: full near by, falling to nothing, then a malus."""
    q = F.col("l_quantity")
    pts = F.when(q <= 10, 30.0).when(q <= 25, F.round(30 - 20 * (q - 10) / 15, 6)).when(q <= 40, F.round(10 - 10 * (q - 25) / 15, 6)).otherwise(-5.0)
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", pts.alias("pts"))


@query("events", sql="SELECT e.event_id, (SELECT max(p.event_id) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND (p.ts, p.event_id) < (e.ts, e.event_id)) AS last_purchase FROM events e WHERE e.event_type = 'click'")
def n12_as_of(events):
    """The user's last purchase before each click: one window over the union, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w)
    return events.withColumn("last_purchase", last).filter("event_type = 'click'").select("event_id", "last_purchase")


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d <= 60 THEN round(18 * (1 - d / 60), 6) WHEN d <= 120 THEN round(5 * (1 - (d - 60) / 60), 6) ELSE -5.0 END::DOUBLE AS pts FROM (SELECT *, greatest(0, l_quantity * 3 - 10) AS d FROM lineitem)")
def s19_detour(lineitem):
    d = F.col("l_quantity") * 3
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(S.detour(d, F.lit(0.0), F.lit(10.0)), 6).alias("pts"))


@query("supplier", sql="SELECT s_suppkey, (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(floor(((s_suppkey * 7.3) % 360 + 22.5) / 45) % 8 + 1)::INTEGER] AS dir FROM supplier")
def s18_compass(supplier):
    return supplier.select("s_suppkey", S.compass((F.col("s_suppkey") * 7.3) % 360).alias("dir"))


@query("part", sql="SELECT p_partkey, p_size * 1.0 - CASE WHEN p_type = 'ECONOMY' THEN 5 ELSE 0 END + CASE WHEN contains(p_name, 'red') THEN 3 ELSE 0 END AS score FROM part")
def s37_rule_score(part):
    """Size, less a malus by type, plus a bonus by name."""
    made = [rule("size", 1, 0, per="size", factor=1), rule("economy", 2, -5, None, [when("type", "is", "ECONOMY")]), rule("red", 3, 3, None, [when("name", "has", "red")])]
    facts = {"size": F.col("p_size"), "type": F.col("p_type"), "name": F.col("p_name")}
    return evaluate(part, *tables(part.sparkSession, made), facts).select("p_partkey", F.col("points").alias("score"))


@query("events", sql="WITH b(event_type, pts) AS (VALUES ('purchase', 5.0::DOUBLE), ('click', 2.0::DOUBLE)) SELECT user_id, sum(coalesce(pts, 0)) AS pts FROM events LEFT JOIN b USING (event_type) GROUP BY user_id")
def s39_boost_table(events):
    """Points by category from a rule table, none for a category that it lacks."""
    rules = events.sparkSession.createDataFrame([("purchase", 5.0), ("click", 2.0)], "event_type string, pts double")
    return events.join(F.broadcast(rules), "event_type", "left").groupBy("user_id").agg(F.sum(F.coalesce("pts", F.lit(0.0))).alias("pts"))


@query("part", sql="SELECT p_partkey, concat_ws('; ', CASE WHEN p_size > 25 THEN 'large' END, CASE WHEN p_retailprice > 1000 THEN 'dear' END, p_brand) AS reason FROM part")
def s41_reason(part):
    """The reasons of the rules that hold for a part, then its brand."""
    made = [rule("large", 1, 0, "large", [when("size", "above", low=25)]), rule("dear", 2, 0, "dear", [when("price", "above", low=1000)])]
    out = evaluate(part, *tables(part.sparkSession, made), {"size": F.col("p_size"), "price": F.col("p_retailprice")})
    return out.select("p_partkey", F.concat_ws("; ", "reasons", "p_brand").alias("reason"))


@query("events", sql="SELECT event_id, TRY_CAST(json_extract('{\"k\": ' || (event_id % 7) || '}', '$.k') AS BIGINT) AS k FROM events")
def s29_json_repair(events):
    """JSON between code fences and other text: the outermost braces."""
    raw = F.concat(F.lit('noise ```{"k": '), (F.col("event_id") % 7).cast("string"), F.lit("}``` noise"))
    return events.select("event_id", F.from_json(F.regexp_extract(raw, r"(\{.*\})", 1), "k long")["k"].alias("k"))


@query("events", sql="SELECT event_type, map_keys(m) AS ks FROM (SELECT event_type, map_from_entries(list_sort(list(DISTINCT struct_pack(k := user_id % 5, v := 1)))) AS m FROM events GROUP BY event_type)")
def g8_map_ops(events):
    entries = F.array_sort(F.collect_set(F.struct((F.col("user_id") % 5).alias("k"), F.lit(1).alias("v"))))
    return events.groupBy("event_type").agg(F.map_keys(F.map_from_entries(entries)).alias("ks"))


@query("embeddings", sql="SELECT label, i::INTEGER AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i")
def g10_centroids(emb):
    rows = emb.select("label", F.posexplode("embedding").alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
