"""Quality rules: learned decision lists over document statistics (operator 1, DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Statistics that conditions may test.
FEATURES = ("n_words", "mean_word_chars", "symbols_per_word", "bangs_per_word", "bars_per_word", "upper_ratio", "dup_line_ratio", "repeat_ratio", "words_per_line")
QUANTILES = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998)
#: Labelled rows that a list is fitted on, at most; the first by hash of doc_id.
MAX_LABELLED = 20_000
#: Rows of the sample in a partition.
SAMPLE_ROWS = 4_000


def statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key and the statistics of each whole text (null: as empty).

    Five-word windows are compared by a 64-bit hash of their words. A word is in a repeated window if one
    of the windows that start at it or up to four words before occurs twice or more in the text.
    """
    t = docs.select(key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    s = t.select(key, "t", F.array_remove(F.split("t", SPACE), "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"))
    n = F.size("w")
    s = s.select(
        key,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        (F.length("t") - F.length(F.replace("t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        (F.length("t") - F.length(F.replace("t", F.lit("|"), F.lit("")))).cast("long").alias("n_bars"),
        F.regexp_count("t", F.lit(r"[A-Z]")).cast("long").alias("n_upper"),
        F.size("l").cast("long").alias("n_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    # Hashes of one word, then of two, four and five words from each place on.
    joined = lambda a, b, by: F.zip_with(a, F.slice(b, by + 1, F.greatest(F.size(b) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))
    s = s.withColumn("h2", joined("h", "h", 1))
    s = s.withColumn("h4", joined("h2", "h2", 2))
    s = s.withColumn("h", F.slice(joined("h4", "h", 4), 1, F.greatest(F.size("h") - (WINDOW - 1), F.lit(0)))).drop("h2", "h4")
    s = s.withColumn("o", F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twice = F.filter("o", lambda e, k: (e.x == F.get("o", k - 1).x) | (e.x == F.get("o", k + 1).x))
    s = s.withColumn("at", F.sort_array(F.transform(twice, lambda e: e.i)))
    covered = F.aggregate(F.transform("at", lambda x, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), x - F.get("at", k - 1)))), F.lit(0).cast("long"), lambda a, x: a + x)
    s = s.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("h", "o", "at")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return s.select(
        "*",
        per("word_chars", "n_words").alias("mean_word_chars"),
        per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_bangs", "n_words").alias("bangs_per_word"),
        per("n_bars", "n_words").alias("bars_per_word"),
        per("n_upper", "word_chars").alias("upper_ratio"),
        per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_repeat_words", "n_words").alias("repeat_ratio"),
        per("n_words", "n_lines").alias("words_per_line"),
    )


@dataclass(frozen=True)
class Condition:
    """feature > threshold, or feature <= threshold."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.col(self.feature).cast("double")
        return x > self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def matches(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn(stats: DataFrame, max_rules: int = 8, max_conditions: int = 3, least_covered: int = 5, precision: float = 0.9) -> list[Rule]:
    """Rules that find low quality, in the order learned, from statistics with columns ``bad`` (0/1) and ``fold`` (grow below 2, prune 2).

    Sequential covering: a rule grows by the condition of most information gain on the growing part of what
    no rule covers yet, loses last conditions while that doesn't lower its worth on the pruning part, and is
    kept if its precision there is at least ``precision``. Every count is one grouped aggregate; the driver
    sees a row for each feature and bin. The thresholds are exact quantiles of the bounded sample, so a rerun
    learns the same list however the sample was dealt.
    """
    edges_row = stats.agg(*(F.percentile(F.col(f).cast("double"), list(QUANTILES)).alias(f) for f in FEATURES)).first()
    edges = {f: sorted(set(edges_row[f] or [])) for f in FEATURES}
    bins = [F.struct(F.lit(f).alias("f"), sum((F.when(F.col(f) > e, 1).otherwise(0) for e in edges[f][1:]), F.when(F.col(f) > edges[f][0], 1).otherwise(0)).alias("b")) for f in FEATURES if edges[f]]
    rules: list[Rule] = []
    if not bins:
        return rules
    left = stats
    while len(rules) < max_rules:
        rule: Rule = ()
        while len(rule) < max_conditions:
            rows = left.filter("fold < 2").filter(matches(rule)).select("bad", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
            best = None
            for f in FEATURES:
                mine = {r.b: (r.p, r.n) for r in rows if r.f == f}
                p0, n0 = (sum(v[k] for v in mine.values()) for k in (0, 1))
                if not p0 or p0 == n0:
                    continue
                p = n = 0
                for b, edge in enumerate(edges[f]):  # bin b: values up to edge b and over the one before
                    p, n = p + mine.get(b, (0, 0))[0], n + mine.get(b, (0, 0))[1]
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        if pp >= least_covered and nn < n0 and (gain := pp * (log2(pp / nn) - log2(p0 / n0))) > (best[0] if best else 1e-9):
                            best = (gain, Condition(f, above, edge), pp == nn)
            if best is None:
                break
            rule += (best[1],)
            if best[2]:
                break
        if not rule:
            break
        cuts = [rule[: k + 1] for k in range(len(rule))]
        sums = left.filter("fold = 2").agg(*(F.sum(F.when(matches(c), F.col("bad"))).alias(f"p{k}") for k, c in enumerate(cuts)), *(F.count(F.when(matches(c), 1)).alias(f"n{k}") for k, c in enumerate(cuts))).first()
        worth = [((2 * (sums[f"p{k}"] or 0) - sums[f"n{k}"]) / sums[f"n{k}"] if sums[f"n{k}"] else -1.0) for k in range(len(cuts))]
        k = len(cuts) - 1
        while k and worth[k - 1] >= worth[k]:
            k -= 1
        if not sums[f"n{k}"] or (sums[f"p{k}"] or 0) < precision * sums[f"n{k}"]:
            break
        rules.append(cuts[k])
        left = left.filter(~matches(cuts[k]))
    return rules


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Statistics of a bounded sample of labelled documents, with bad and fold."""
    pick = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (1 - F.col("quality")).cast("long").alias("bad"), F.xxhash64("doc_id").alias("k"))
    pick = pick.orderBy("k", "doc_id", "bad").limit(max_labelled).select("doc_id", "bad", F.pmod("k", F.lit(3)).cast("int").alias("fold"))
    return statistics(docs.join(F.broadcast(pick.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(pick), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    ws = Workspace(docs.sparkSession, "rules")
    # Written by as many tasks as the scan has, then brought together: the sample is small, the scan isn't.
    rows = ws.table(labelled(docs.select("doc_id", "text"), labels, max_labelled))
    stats = ws.table(rows.repartition(max(1, -(-max_labelled // SAMPLE_ROWS)), "doc_id"))
    ws.drop(rows)
    rules = learn(stats)
    ws.drop(stats)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The first rule that holds, as an ordered conditional expression; null: none, the document is kept."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(matches(rule), F.lit(" AND ".join(map(str, rule)))).otherwise(out)
    return out


def decided(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics with base_failed, rule and kept."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    s = stats.withColumn("base_failed", base).withColumn("rule", verdict(rules))
    return s.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the rule that decided.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. kept: neither that nor a
    learned rule. Null and empty texts have no words and fail. Repeated rows each give a row. Columns other
    than doc_id and text are ignored. Without labelled rows there are no rules and the base decides.
    """
    s = decided(statistics(docs.select("doc_id", "text")), rules)
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents, all columns, that the base and the rules keep."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), "text")
    # A filter isn't moved below a column that isn't deterministic. Below the statistics it would repeat
    # their nested expressions, which double at each step.
    stats = statistics(packed, "row").withColumn("place", F.monotonically_increasing_id())
    return decided(stats, rules).filter("kept AND place >= 0").select("row.*")
