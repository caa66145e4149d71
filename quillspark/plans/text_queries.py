"""Queries of text functions, chunking, guards and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import retrieval as R
from quillspark.operators.chunking import chunk_documents, compress_texts, split_documents
from quillspark.operators.evaluation import composite, pseudonym, rouge_l, sequence_similarity
from quillspark.operators.rules import first_reason, rule, tables, when

from .register import query
from .retrieval_queries import BM25_CTE, token_sql

FOLD_SQL = f"translate(lower({{}}), '{T.FOLD_FROM}', '{T.FOLD_TO}')"


@query("documents", sql=f"SELECT doc_id, len({token_sql('text')})::BIGINT AS n, len(list_distinct({token_sql('text')}))::BIGINT AS n_distinct FROM documents")
def s6_tokenise(docs):
    w = T.tokens(F.col("text"))
    return docs.select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("documents", sql=f"SELECT doc_id, md5({FOLD_SQL.format('text')}) AS folded FROM documents")
def s1_fold(docs):
    return docs.select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query("documents", sql=rf"SELECT doc_id, md5(regexp_replace(trim({FOLD_SQL.format('text')}), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) AS form FROM documents")
def s3_normalise(docs):
    return docs.select("doc_id", F.md5(T.normalise(F.col("text"))).alias("form"))


@query("documents", sql=r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM documents")
def s4_metric_form(docs):
    return docs.select("doc_id", F.md5(T.metric_form(F.col("text"))).alias("form"))


@query("pages", sql=r"SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '<[^>]{1,200}>', ' ', 'g'), '[ ]{3,}', '  ', 'g')))::BIGINT AS n FROM pages")
def s7_sanitise_html(pages):
    return pages.select("page_id", F.length(T.sanitise(F.col("html"))).cast("long").alias("n"))


@query("conversations", sql="""SELECT conv_id, turn, translate(trim(substring(text, 1, 200)), '<>"''', '') AS q FROM conversations""")
def s8_query_form(chats):
    return chats.select("conv_id", "turn", T.query_form(F.col("text")).alias("q"))


@query("documents", sql=r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}')))[1:5] AS names FROM documents")
def s14_capitalised(docs):
    """The first five of the distinct capitalised words."""
    return docs.select("doc_id", F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{6,}"), F.lit(0)))), 1, 5).alias("names"))


@query("documents")
def s14_capitalised_whole(docs):
    """All the distinct capitalised names and acronyms, sorted; word ends are Unicode's, as in the reference."""
    return docs.select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b([A-Z][a-zA-Z0-9_\-]{2,}|[A-Z]{2,})\b"), F.lit(1)))).alias("names"))


#: Rules of entities: name, pattern.
ENTITY_RULES = (("NUMBER", "[0-9]{2,}"), ("MAIL", "[a-z0-9.]+@[a-z0-9.]+"), ("URL", "https?://[^ ]+"))


@query("documents", sql=" UNION ALL ".join(f"SELECT DISTINCT doc_id, x AS name, '{n}' AS kind FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{p}')) AS x FROM documents)" for n, p in ENTITY_RULES))
def s11_regex_entities(docs):
    found = F.array(*(F.struct(F.lit(n).alias("kind"), F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)).alias("xs")) for n, p in ENTITY_RULES))
    rows = docs.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.kind", F.explode("f.xs").alias("name"))
    return rows.select("doc_id", "name", "kind").distinct()


@query("documents", sql="SELECT doc_id, CASE WHEN regexp_matches(lower(source), 'src1') THEN 'one' WHEN regexp_matches(left(lower(text), 2000), 'the') THEN 'english' ELSE 'general' END AS kind FROM documents")
def s15_doc_type(docs):
    """By name first, then by the head of the text; the first rule that matches."""
    return docs.select("doc_id", F.when(F.lower("source").contains("src1"), "one").when(F.left(F.lower("text"), F.lit(2000)).contains("the"), "english").otherwise("general").alias("kind"))


@query("documents", sql=r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, length(t), 630)) AS start FROM t)
SELECT doc_id, (start // 630)::BIGINT AS chunk_index, start::BIGINT AS start, length(substring(t, start + 1, 750))::BIGINT AS n FROM c""")
def g3_sliding_chunks(docs):
    flat = docs.select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    return flat.select("doc_id", F.explode(T.windows(F.col("t"))).alias("c")).select("doc_id", "c.chunk_index", "c.start", F.length("c.body").cast("long").alias("n"))


@query("documents", sql=r"SELECT doc_id, (len(regexp_extract_all(trim(text), '[.!?]\s+')) + 1)::BIGINT AS n FROM documents")
def g5_sentences(docs):
    return docs.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query("documents", sql=r"""SELECT doc_id, length(text) < 60 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(text), 1) < 0.25 OR regexp_matches(text, '(\*\*\*|\$\$\$)') AS noise FROM documents""")
def f2_noise(docs):
    ratio = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) / F.greatest(F.length("text"), F.lit(1))
    return docs.select("doc_id", ((F.length("text") < 60) | (ratio < 0.25) | F.col("text").rlike(r"(\*\*\*|\$\$\$)")).alias("noise"))


@query("documents", sql=f"SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS n FROM documents GROUP BY left({FOLD_SQL.format('text')}, 180)")
def w2_prefix_dedup(docs):
    """The first document of each folded prefix."""
    return docs.groupBy(F.left(T.fold(F.col("text")), F.lit(180)).alias("p")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("p")


@query("documents", sql="""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, range(1, 400) t(i) WHERE i <= len(string_split(text, chr(10))) AND len(string_split(text, chr(10))) < 400),
h AS (SELECT *, sum(CASE WHEN length(line) <= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l)
SELECT doc_id, part::BIGINT AS part, count(*)::BIGINT AS n_lines, sum(length(line))::BIGINT AS n FROM h GROUP BY doc_id, part""")
def g1_heading_split(docs):
    """Parts of a document, each from a short line to the next (of documents under 400 lines)."""
    lines = docs.filter(F.size(F.split("text", "\n")) < 400).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    part = F.sum(F.when(F.length("line") <= 60, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.withColumn("part", part.cast("long")).groupBy("doc_id", "part").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n"))


@query("documents")
def g1_heading_split_whole(docs):
    """Articles of every document by its headings, long ones packed; documents of fewer than two headings packed whole."""
    return split_documents(docs).select("doc_id", "article", "chunk_index", F.length("body").alias("n"))


#: Ordered guard rules: id, pattern on the folded text.
GUARD_RULES = ((1, "ignore .* instructions"), (2, "(pass)?word"), (3, "the [a-z]+tion"), (4, "que "))
_GUARD = " ".join(f"WHEN regexp_matches({FOLD_SQL.format('text')}, '{p}') THEN {i}" for i, p in GUARD_RULES)


@query("documents", sql=f"SELECT doc_id, (CASE {_GUARD} END)::INTEGER AS rule_id FROM documents")
def f3_injection_scan(docs):
    """The first guard rule that a text meets."""
    made = [rule(str(i), i, 0, str(i), [when("folded", "matches", p)]) for i, p in GUARD_RULES]
    out = first_reason(docs.select("doc_id", T.fold(F.col("text")).alias("folded")), *tables(docs.sparkSession, made), {"folded": F.col("folded")}, "rule_id")
    return out.select("doc_id", F.col("rule_id").cast("int").alias("rule_id"))


#: Ordered signs, on the folded text, of an answer that isn't drawn from its context.
MARKERS = (
    r"theo\s+(toi|minh)\s+(biet|nghi|hieu|suy\s*nghi|ung\s*doan)",
    r"toi\s+(nghi|doan|tuong|cho\s+rang|uoc\s+tinh)\b",
    r"\bi\s+(think|believe|guess|assume|suppose|imagine)\b",
    r"(?s)\b(probably|likely|perhaps|maybe|possibly)\b.{0,20}\b(is|are|was|were|will)\b",
    r"i['`]m\s+not\s+(sure|certain|100%|fully)",
    r"\b(co\s*le\s*la|duong\s*nhu\s*la|co\s*the\s*la)\b",
    r"khong\s*chinh\s*xac\s*nhung",
    r"\b(as\s+far\s+as\s+i\s+know|to\s+my\s+knowledge|i\s+recall)\b",
    r"(based\s+on\s+my\s+training|my\s+knowledge\s+cutoff)",
    r"toi\s+khong\s+co\s+thong\s+tin\s+chinh\s+xac",
)
_MARKED = ", ".join(f"nullif(left(regexp_extract(folded, '{p}', 0), 80), '')" for p in (m.replace("'", "''") for m in MARKERS))


def first_marker(text: Column) -> Column:
    """What the first of ``MARKERS`` to be found matches, 80 characters at most; null if none is, or for a null text."""
    folded = T.fold(text)
    return F.coalesce(*(F.nullif(F.left(F.regexp_extract(folded, p, 0), F.lit(80)), F.lit("")) for p in MARKERS))


@query("conversations", sql=f"SELECT conv_id, turn, role, coalesce({_MARKED}) AS marker FROM (SELECT *, {FOLD_SQL.format('text')} AS folded FROM conversations)")
def f5_marker_scan(chats):
    """The first sign of a made-up answer in every turn."""
    return chats.select("conv_id", "turn", "role", first_marker(F.col("text")).alias("marker"))


@query("conversations", sql=f"SELECT conv_id, turn, CASE WHEN length(text) > 1500 THEN 'block' WHEN regexp_matches({FOLD_SQL.format('text')}, 'worthless|stupid') THEN 'warn' ELSE 'allow' END AS action FROM conversations")
def f4_input_guard(chats):
    """What a guard of two rules does with a turn; ``f4_guard_cascade`` has the whole cascade."""
    made = [rule("long", 1, 0, "block", [when("length", "above", low=1500)]), rule("harsh", 2, 0, "warn", [when("folded", "matches", "worthless|stupid")])]
    out = first_reason(chats, *tables(chats.sparkSession, made), {"length": F.length("text"), "folded": T.fold(F.col("text"))}, "action", "allow")
    return out.select("conv_id", "turn", "action")


@query("conversations", sql="SELECT conv_id, turn, len(string_split(trim(text), ' ')) < 12 AND regexp_matches(lower(text), 'the|que|der') AS follow_up FROM conversations")
def f11_follow_up(chats):
    return chats.select("conv_id", "turn", ((F.size(F.split(F.trim("text"), " ")) < 12) & F.lower("text").rlike("the|que|der")).alias("follow_up"))


@query("conversations", sql="""WITH w AS (SELECT conv_id, turn, len(string_split(trim(text), ' ')) AS n FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN n >= 30 THEN 'complex' WHEN n >= 15 THEN 'medium' ELSE 'simple' END AS tier, CASE WHEN n >= 30 THEN 15 WHEN n >= 15 THEN 10 ELSE 6 END::INTEGER AS top_k, CASE WHEN n >= 30 THEN 2 WHEN n >= 15 THEN 1 ELSE 0 END::INTEGER AS hops FROM w""")
def v21_router_tier(chats):
    n = F.size(F.split(F.trim("text"), " "))
    params = lambda *x: F.struct(*(F.lit(v).alias(k) for k, v in zip(("tier", "top_k", "hops"), x)))
    tier = F.when(n >= 30, params("complex", 15, 2)).when(n >= 15, params("medium", 10, 1)).otherwise(params("simple", 6, 0))
    return chats.filter("role = 'user'").select("conv_id", "turn", tier.alias("t")).select("conv_id", "turn", "t.*")


@query("conversations", sql="SELECT conv_id, (sum(length(text)) // 2 + 10 * count(*))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def s30_token_estimate(chats):
    return chats.groupBy("conv_id").agg((F.floor(F.sum(F.length("text")) / 2) + 10 * F.count("*")).cast("long").alias("tokens"))


@query("conversations", sql=f"""WITH a AS (SELECT conv_id, turn, list_distinct([x for x in {token_sql('text')} if len(x) >= 3]) AS w, lag(list_distinct({token_sql('text')})) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS c, role FROM conversations)
SELECT conv_id, turn, round(CASE WHEN len(w) = 0 THEN 1 ELSE len(list_intersect(w, c)) / len(w) END, 6) AS grounding FROM a WHERE role = 'assistant' AND c IS NOT NULL""")
def s34_grounding(chats):
    """Part of an answer's longer words that the turn before has."""
    before = F.lag(T.tokens(F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    rows = chats.withColumn("c", before).filter("role = 'assistant' AND c IS NOT NULL")
    own = F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3)
    return rows.select("conv_id", "turn", F.round(T.overlap(own, F.col("c")), 6).alias("grounding"))


@query("documents", sql="SELECT doc_id, concat_ws(' | ', CASE WHEN lang <> 'en' THEN 'type: ' || lang END, 'source: ' || source) || chr(10) || left(text, 50) AS enriched FROM documents")
def j1_contextual_prefix(docs):
    return docs.select("doc_id", F.concat(F.concat_ws(" | ", F.when(F.col("lang") != "en", F.concat(F.lit("type: "), "lang")), F.concat(F.lit("source: "), "source")), F.lit("\n"), F.left("text", F.lit(50))).alias("enriched"))


@query("documents", sql="SELECT doc_id, concat_ws(' | ', CASE WHEN lang <> 'en' THEN 'type: ' || lang END, 'source: ' || source) || chr(10) || text AS enriched FROM documents")
def j1_contextual_prefix_whole(docs):
    """The prefix before the whole text."""
    return docs.select("doc_id", F.concat(F.concat_ws(" | ", F.when(F.col("lang") != "en", F.concat(F.lit("type: "), "lang")), F.concat(F.lit("source: "), "source")), F.lit("\n"), "text").alias("enriched"))


@query("documents", sql=f"""WITH t AS (SELECT doc_id, unnest({token_sql('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS cf FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2""")
def a10_term_stats(docs):
    """Document and collection frequency of terms; each document's repeats are summed before the terms meet."""
    per_doc = docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).filter("df >= 2")


@query("documents", sql="SELECT CASE WHEN n_chars < 100 THEN '0' WHEN n_chars < 300 THEN '100' WHEN n_chars < 500 THEN '300' WHEN n_chars < 700 THEN '500' WHEN n_chars < 900 THEN '700' ELSE '900' END AS bucket, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def a9_size_histogram(docs):
    n = F.col("n_chars")
    bucket = F.when(n < 100, "0").when(n < 300, "100").when(n < 500, "300").when(n < 700, "500").when(n < 900, "700").otherwise("900")
    return docs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query("documents", sql="SELECT source, count(*)::BIGINT AS n_docs, count(DISTINCT text)::BIGINT AS n_texts FROM documents GROUP BY source")
def a13_sources(docs):
    """Texts are told apart by a 128-bit hash, so whole texts aren't shuffled."""
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.countDistinct(F.md5("text")).alias("n_texts"))


@query("documents", "labels", sql="""SELECT lang, grouping(lang)::INTEGER AS grp, count(*)::BIGINT AS n, round(avg(quality), 6) AS mean_q, round(stddev_samp(n_chars), 4) AS std_chars
FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))""")
def a5_grouping_sets(docs, labels):
    rows = docs.select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    return rows.rollup("lang").agg(F.grouping("lang").cast("int").alias("grp"), F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_q"), F.round(F.stddev_samp("n_chars"), 4).alias("std_chars"))


@query("labels", sql="SELECT count(*)::BIGINT AS n, round(avg(toxic), 6) AS toxic_rate, round(avg(quality), 6) AS quality_rate, round(avg(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END), 6) AS both_rate FROM labels")
def a4_rates(labels):
    return labels.agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.avg("quality"), 6).alias("quality_rate"), F.round(F.avg(((F.col("toxic") == 1) & (F.col("quality") == 1)).cast("int")), 6).alias("both_rate"))


@query("conversations", sql="""WITH r AS (SELECT conv_id, turn, 1 + turn % 5 AS reward FROM conversations)
SELECT conv_id, (min(struct_pack(o := -reward, t := turn)) FILTER (reward >= 4)).t AS chosen_turn, (min(struct_pack(o := reward, t := turn)) FILTER (reward <= 2)).t AS rejected_turn
FROM r GROUP BY conv_id HAVING count(*) FILTER (reward >= 4) > 0 AND count(*) FILTER (reward <= 2) > 0""")
def a2_preference_pairs(chats):
    """The best and the worst rated turn of each conversation that has both."""
    r = chats.select("conv_id", "turn", (1 + F.col("turn") % 5).alias("reward"))
    good, bad = F.col("reward") >= 4, F.col("reward") <= 2
    pairs = r.groupBy("conv_id").agg(F.min(F.when(good, F.struct((-F.col("reward")).alias("o"), "turn"))).alias("g"), F.min(F.when(bad, F.struct(F.col("reward").alias("o"), "turn"))).alias("b"))
    return pairs.filter("g IS NOT NULL AND b IS NOT NULL").select("conv_id", F.col("g.turn").alias("chosen_turn"), F.col("b.turn").alias("rejected_turn"))


@query("conversations", sql=f"""WITH t AS (SELECT (turn % 5 - 2) / 2.0 AS r, unnest(list_distinct([x for x in {token_sql('text')} if len(x) >= 3])) AS token FROM conversations)
SELECT token, round(avg(r), 6) AS weight, count(*)::BIGINT AS n FROM t GROUP BY token HAVING count(*) >= 2 ORDER BY round(abs(avg(r)), 6) DESC, token LIMIT 50""")
def a6_keyword_reward(chats):
    """The fifty tokens of strongest mean reward."""
    t = chats.select(((F.col("turn") % 5 - 2) / 2.0).alias("r"), F.explode(F.array_distinct(F.filter(T.tokens(F.col("text")), lambda x: F.length(x) >= 3))).alias("token"))
    means = t.groupBy("token").agg(F.avg("r").alias("m"), F.count("*").alias("n")).filter("n >= 2")
    return means.orderBy(F.desc(F.round(F.abs("m"), 6)), "token").limit(50).select("token", F.round("m", 6).alias("weight"), "n")


@query("documents", "benchmark", sql=r"""SELECT item_id, round(len([x for x in k if contains(lower(d.text), x)]) / greatest(1, len(k)), 6) AS coverage
FROM (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}]{7,}'))) AS k FROM benchmark) JOIN documents d ON d.doc_id = item_id""")
def s33_coverage(docs, bench):
    """Part of an item's long words that the document of its number holds."""
    keys = bench.select("item_id", F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{7,}"), F.lit(0)))).alias("k"))
    rows = keys.join(docs.select(F.col("doc_id").alias("item_id"), F.lower("text").alias("t")), "item_id")
    return rows.select("item_id", F.round(F.size(F.filter("k", lambda x: F.contains("t", x))) / F.greatest(F.lit(1), F.size("k")), 6).alias("coverage"))


@query("documents")
def g2_packed_chunks(docs):
    """Chunks of whole sentences near a target size, with overlap."""
    return chunk_documents(docs).select("doc_id", "chunk_index", F.length("body").alias("n"))


def _hit_pairs(docs, bench):
    """(item_id, doc_id, reference, answer): each item's whole text with those of its ten best documents.

    Texts of hits are dealt out by pair, so that slow comparisons spread over the tasks.
    """
    hits = R.bm25(docs, bench, "doc_id", "item_id", 10).select("item_id", "doc_id")
    pairs = R.with_documents(hits, docs.select("doc_id", F.col("text").alias("answer")), "doc_id").join(bench.select("item_id", F.col("text").alias("reference")), "item_id")
    return pairs.repartition("item_id", "doc_id")


@query("documents", "benchmark")
def s31_rouge_l(docs, bench):
    """ROUGE-L of each item against its ten best documents."""
    return rouge_l(_hit_pairs(docs, bench), "item_id", "doc_id")


@query("documents", "benchmark")
def s32_sequence_similarity(docs, bench):
    return _hit_pairs(docs, bench).select("item_id", "doc_id", sequence_similarity("reference", "answer").alias("similarity"))


@query("documents", "benchmark", sql=rf"""WITH {BM25_CTE}, k AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}]{{7,}}')) AS k FROM benchmark)
SELECT item_id, doc_id, round(len([x for x in k if contains(lower(bd.text), x)]) / greatest(1, len(k)), 6) AS coverage FROM bm JOIN bd USING (doc_id) JOIN k USING (item_id) WHERE rank <= 10""")
def s33_coverage_whole(docs, bench):
    """Part of an item's long words that each of its ten best documents holds."""
    keys = F.array_distinct(F.regexp_extract_all(F.lower("reference"), F.lit(r"[\p{L}]{7,}"), F.lit(0)))
    rows = _hit_pairs(docs, bench).select("item_id", "doc_id", keys.alias("k"), F.lower("answer").alias("t"))
    return rows.select("item_id", "doc_id", F.round(F.size(F.filter("k", lambda x: F.contains("t", x))) / F.greatest(F.lit(1), F.size("k")), 6).alias("coverage"))


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE} SELECT item_id, doc_id, regexp_matches(lower(bd.text), '(^|[^0-9])' || (item_id % 10)::VARCHAR || '([^0-9]|$)') AS cited FROM bm JOIN bd USING (doc_id) WHERE rank <= 10""")
def s16_citation_whole(docs, bench):
    """Whether each of an item's ten best documents cites its number."""
    rows = _hit_pairs(docs, bench)
    return rows.select("item_id", "doc_id", F.regexp_like(F.lower("answer"), F.concat(F.lit("(^|[^0-9])"), (F.col("item_id") % 10).cast("string"), F.lit("([^0-9]|$)"))).alias("cited"))


@query("documents", "benchmark", sql=f"""WITH {BM25_CTE} SELECT item_id, doc_id, len(list_intersect(list_distinct(string_split(b.text, ' ')), list_distinct(string_split(bd.text, ' '))))::BIGINT AS n FROM bm JOIN bd USING (doc_id) JOIN benchmark b USING (item_id) WHERE rank <= 10""")
def u3_overlap_size_whole(docs, bench):
    """Words that an item shares with each of its ten best documents."""
    return _hit_pairs(docs, bench).select("item_id", "doc_id", F.size(F.array_intersect(F.split("reference", " "), F.split("answer", " "))).cast("long").alias("n"))


def _padded(x: int) -> str:
    """The key ``salt`` padded to 64 bytes, each XOR x, as a blob."""
    return "'" + "".join(f"\\x{c ^ x:02X}" for c in b"salt".ljust(64, b"\0")) + "'::BLOB"


@query("customer", sql=f"SELECT c_custkey, 'u_' || left(sha256({_padded(0x5C)} || unhex(sha256({_padded(0x36)} || encode(c_name)))), 16) AS pseudonym FROM customer")
def s27_pseudonym(customer):
    return customer.select("c_custkey", pseudonym(F.col("c_name"), "salt").alias("pseudonym"))


@query("documents", "benchmark")
def v20_compress(docs, bench):
    """Each item's ten best documents cut to the sentences nearest to the item."""
    rows = _hit_pairs(docs, bench).select("item_id", "doc_id", F.col("answer").alias("text"), T.tokens(F.col("reference")).alias("words"))
    return compress_texts(rows, "item_id", "doc_id").select("item_id", "doc_id", F.length("body").alias("n"))


@query("documents", sql=r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '-\n', '', 'g'), '\n+', ' ', 'g'))) AS repaired FROM documents")
def s9_text_repair(docs):
    """Hyphenated line ends joined, line breaks as blanks."""
    return docs.select("doc_id", F.md5(F.trim(F.regexp_replace(F.regexp_replace("text", "-\n", ""), "\n+", " "))).alias("repaired"))


@query("part", sql=r"SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')', '[^A-Za-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def s10_entity_name(part):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return part.select("p_partkey", F.trim(F.regexp_replace(F.regexp_replace(raw, "[^A-Za-z0-9 ]", " "), " +", " ")).alias("name"))


@query("documents", sql=r"SELECT doc_id, len([x for x in string_split(text, chr(10)) if regexp_matches(x, '[0-9]+ ?[-+*/=] ?[0-9]+')][1:15])::BIGINT AS n FROM documents")
def s12_formula_lines(docs):
    """The first fifteen lines that look like sums."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[0-9]+ ?[-+*/=] ?[0-9]+"))
    return docs.select("doc_id", F.size(F.slice(lines, 1, 15)).cast("long").alias("n"))


@query("documents", sql="""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line FROM documents, range(1, 60) t(i) WHERE i <= len(string_split(text, chr(10)))),
h AS (SELECT doc_id, i, last_value(CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS heading FROM l)
SELECT doc_id, i::INTEGER AS i, md5(heading) AS heading FROM h WHERE heading IS NOT NULL""")
def s13_heading_carry(docs):
    """The last short line before each of a document's first lines."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).filter("p < 59").withColumn("i", F.col("p") + 1)
    w = Window.partitionBy("doc_id").orderBy("i")
    heading = F.last(F.when(F.length("line").between(1, 40), F.col("line")), ignorenulls=True).over(w)
    return lines.withColumn("h", heading).filter("h IS NOT NULL").select("doc_id", "i", F.md5("h").alias("heading"))


@query("documents", sql="""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, i, last_value(CASE WHEN length(line) BETWEEN 1 AND 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS heading FROM l)
SELECT doc_id, i::INTEGER AS i, md5(heading) AS heading FROM h WHERE heading IS NOT NULL""")
def s13_heading_carry_whole(docs):
    """The last short line before each line of a document."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("i", F.col("p") + 1)
    w = Window.partitionBy("doc_id").orderBy("i")
    heading = F.last(F.when(F.length("line").between(1, 40), F.col("line")), ignorenulls=True).over(w)
    return lines.withColumn("h", heading).filter("h IS NOT NULL").select("doc_id", "i", F.md5("h").alias("heading"))


@query("benchmark", "documents", sql="SELECT item_id, regexp_matches(lower(d.text), '(^|[^0-9])' || (item_id % 10)::VARCHAR || '([^0-9]|$)') AS cited FROM benchmark JOIN documents d ON d.doc_id = item_id")
def s16_citation(bench, docs):
    """Whether a text cites its item's number: the pattern is made from the row."""
    rows = bench.select("item_id").join(docs.select(F.col("doc_id").alias("item_id"), F.lower("text").alias("t")), "item_id")
    return rows.select("item_id", F.regexp_like("t", F.concat(F.lit("(^|[^0-9])"), (F.col("item_id") % 10).cast("string"), F.lit("([^0-9]|$)"))).alias("cited"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the ') THEN 'english' WHEN contains(lower(text), 'que ') THEN 'romance' WHEN contains(lower(text), 'der ') THEN 'german' ELSE 'other' END AS intent FROM conversations")
def s36_rule_intent(chats):
    """The first intent that a turn's words show."""
    made = [rule(name, i, 0, name, [when("text", "has", word)]) for i, (word, name) in enumerate((("the ", "english"), ("que ", "romance"), ("der ", "german")))]
    out = first_reason(chats.select("conv_id", "turn", F.lower("text").alias("text")), *tables(chats.sparkSession, made), {"text": F.col("text")}, "intent", "other")
    return out.select("conv_id", "turn", "intent")


@query("conversations", sql="SELECT conv_id, turn, (contains(lower(text), 'scum') OR contains(lower(text), 'stupid') OR contains(lower(text), 'the')) AS found FROM conversations WHERE role = 'assistant'")
def f10_phrase_detection(chats):
    phrases = F.array(*map(F.lit, ("scum", "stupid", "the")))
    return chats.filter("role = 'assistant'").select("conv_id", "turn", F.exists(phrases, lambda p: F.contains(F.lower("text"), p)).alias("found"))


@query("documents", sql=r"SELECT doc_id, regexp_matches(lower(text), '(^|[^a-z])und([^a-z]|$)') AS has_word FROM documents")
def f6_whole_word(docs):
    return docs.select("doc_id", F.lower("text").rlike("(^|[^a-z])und([^a-z]|$)").alias("has_word"))


@query("conversations", sql="SELECT conv_id, turn, (len(string_split(text, ' ')) >= 25 AND regexp_matches(lower(text), 'the|que')) OR len(string_split(text, ' ')) > 60 AS expand FROM conversations")
def f12_expansion_gate(chats):
    n = F.size(F.split("text", " "))
    return chats.select("conv_id", "turn", (((n >= 25) & F.lower("text").rlike("the|que")) | (n > 60)).alias("expand"))


@query("conversations", sql="SELECT conv_id, turn, list_sort([x for x in ['and', 'der', 'que', 'the'] if contains(lower(text), x)]) AS found FROM conversations")
def v22_keyword_entities(chats):
    """Domain keywords that a text holds."""
    return chats.select("conv_id", "turn", F.array_sort(F.filter(F.array(*map(F.lit, ("and", "der", "que", "the"))), lambda x: F.contains(F.lower("text"), x))).alias("found"))


@query("benchmark", sql=f"""WITH t AS (SELECT item_id, unnest({token_sql('text')}) AS w FROM benchmark), s(w, syn) AS (VALUES ('the', 'le'), ('and', 'und'), ('of', 'von'))
SELECT item_id, string_agg(DISTINCT syn, ' ' ORDER BY syn) AS added FROM t JOIN s USING (w) GROUP BY item_id""")
def v24_synonyms(bench):
    """Synonyms of a question's words, from a small rule table."""
    rules = bench.sparkSession.createDataFrame([("the", "le"), ("and", "und"), ("of", "von")], "w string, syn string")
    words = bench.select("item_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    return words.join(F.broadcast(rules), "w").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("syn")), " ").alias("added"))


@query("benchmark", sql="SELECT item_id, len(text) AS n FROM benchmark WHERE item_id > 20 ORDER BY item_id")
def r4_incremental_scan(bench):
    """Rows after the last id that was read."""
    return bench.filter("item_id > 20").select("item_id", F.length("text").cast("long").alias("n"))


@query("labels", sql="SELECT doc_id, 'quality' AS name, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def j2_wide_to_long(labels):
    return labels.unpivot(["doc_id"], ["quality", "toxic"], "name", "value")


@query("documents", sql=r"SELECT doc_id, len([x for x in string_split(text, ' ') if x = 'the'])::BIGINT AS n_the, len([x for x in string_split(text, ' ') if x = 'que'])::BIGINT AS n_que FROM documents")
def j7_bag_of_words(docs):
    """Counts over a fixed vocabulary."""
    count = lambda w: F.size(F.filter(F.split("text", " "), lambda x: x == w)).cast("long")
    return docs.select("doc_id", count("the").alias("n_the"), count("que").alias("n_que"))


@query("labels", "documents", sql="""WITH r AS (SELECT doc_id, least(n_chars / 5000.0, 1)::DOUBLE AS rouge, quality::DOUBLE AS kw, 8.0::DOUBLE AS judge FROM labels JOIN documents USING (doc_id)),
c AS (SELECT *, CASE WHEN rouge < 0.05 AND kw = 0 AND judge > 4 THEN 4.0 ELSE judge END AS j1 FROM r), d AS (SELECT *, CASE WHEN rouge < 0.15 AND kw < 0.2 AND j1 > 5 THEN 5.0 ELSE j1 END AS j2 FROM c)
SELECT doc_id, round(0.5 * j2 + 2 * rouge + 2 * kw + rouge, 4) AS composite FROM d""")
def s35_composite(labels, docs):
    rows = labels.join(docs.select("doc_id", "n_chars"), "doc_id")
    rouge, kw = F.least(F.col("n_chars") / 5000.0, F.lit(1.0)), F.col("quality").cast("double")
    return rows.select("doc_id", composite(F.lit(8.0), rouge, kw, rouge, F.lit(False), rouge).alias("composite"))
