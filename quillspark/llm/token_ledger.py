"""Token counts: delta-maintained rollups with idempotent batch commits (operator 4)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import shared_dir

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"

#: Tokenizer versions that count with built-in functions: words between blanks, and runs of letters, digits and marks beyond ASCII.
TOKENIZERS = {"blank-1": r"[^\x20\x09-\x0D]+", "alnum-1": r"[0-9A-Za-z\u0080-\x{10FFFF}]+"}


def token_count(version: str, text: Column) -> Column:
    """Tokens of a text under a version; null counts 0."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENIZERS[version]), F.lit(0))).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """Additive deltas of changes (change, source, lang, tokenizer, tokens, old_tokens).

    insert: a document more and its tokens; delete: one less and its tokens off; revise: tokens less
    old_tokens. Null counts are 0, null keys are a key, and any other change is no change. Summed before the
    shuffle, so a hot key costs no more than another.
    """
    n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("tokens", "old_tokens"))
    docs = F.when(F.col("change") == "insert", 1).when(F.col("change") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("change") == "insert", n).when(F.col("change") == "delete", -n).when(F.col("change") == "revise", n - old).otherwise(F.lit(0))
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens"))


class TokenLedger:
    """Totals by source, language and tokenizer version, kept as one small table of deltas for each batch."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path.rstrip("/") if path else f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def committed(self, batch: str) -> bool:
        fs, done = self._fs(f"{self.path}/batch={batch}/_SUCCESS")
        return fs.exists(done)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing happens, if it was added before.

        The writer's _SUCCESS file marks the batch as whole. A batch whose writer was lost has none, is not
        counted, and is written anew by the next try.
        """
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return True

    def batches(self) -> list[str]:
        return sorted(b for b in self._names("batch=") if self.committed(b))

    def _names(self, prefix: str) -> list[str]:
        fs, root = self._fs(self.path)
        found = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return [x[len(prefix) :] for x in found if x.startswith(prefix)]

    def _snapshot(self) -> tuple[int, list[str]]:
        """The number of the latest whole snapshot (0: none), and the batches that it has taken in."""
        whole = [int(n) for n in self._names("snapshot=") if self._whole(f"snapshot={n}") and self._whole(f"taken={n}")]
        if not whole:
            return 0, []
        return max(whole), [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/taken={max(whole)}").collect()]

    def _whole(self, name: str) -> bool:
        fs, done = self._fs(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(done)

    def compact(self) -> int:
        """Sum the batches so far into a snapshot, which ``totals`` reads in their place; the number of batches in it.

        The batches' folders stay, so a batch that a snapshot has taken in is still known as committed. A
        snapshot counts once both its sums and its list of batches are whole.
        """
        number, taken = self._snapshot()
        batches = self.batches()  # the sums and the list are of these; a batch committed from here on is in neither
        if set(batches) == set(taken):
            return len(taken)
        at = number + 1
        self._sums(number, taken, batches).write.mode("overwrite").parquet(f"{self.path}/snapshot={at}")
        self.spark.createDataFrame([(b,) for b in batches], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/taken={at}")
        return len(batches)

    def _sums(self, number: int, taken: list[str], batches: list[str]) -> DataFrame:
        """The sums of a snapshot and of the batches that it hasn't taken in."""
        known = set(taken)
        paths = [f"{self.path}/batch={b}" for b in batches if b not in known] + ([f"{self.path}/snapshot={number}"] if number else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))

    def totals(self) -> DataFrame:
        """The sums over all whole batches; keys that have come to nothing are left out."""
        return self._sums(*self._snapshot(), self.batches()).filter("docs <> 0 OR tokens <> 0")


def counted(docs: DataFrame, versions: tuple[str, ...] = tuple(TOKENIZERS)) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens): a row for each row of documents and version.

    Null and empty texts count 0 tokens, null sources and languages are keys of their own, repeated rows each
    count, other columns are ignored, and an empty table gives no row.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.array(*(F.struct(F.lit(v).alias("tokenizer"), token_count(v, F.col("text").cast("string")).alias("tokens")) for v in versions)).alias("x"))
    return rows.select("doc_id", "source", "lang", F.explode("x").alias("x")).select("doc_id", "source", "lang", "x.tokenizer", "x.tokens")


def maintain(labels: DataFrame, ledger: TokenLedger, counts: DataFrame) -> DataFrame:
    """Totals after three batches, the last one committed twice.

    Every document comes in under each version; documents labelled toxic go; the ``blank-1`` counts of
    those of low quality that stay are revised to their ``alnum-1`` counts.
    """
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    poor = labels.filter("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    none = F.lit(None).cast("long").alias("old_tokens")
    ledger.commit("1-load", counts.select(F.lit("insert").alias("change"), *KEYS, "tokens", none))
    ledger.commit("2-toxic", counts.join(toxic, "doc_id", "left_semi").select(F.lit("delete").alias("change"), *KEYS, "tokens", none))
    new = counts.filter("tokenizer = 'alnum-1'").select("doc_id", F.col("tokens").alias("new"))
    revised = counts.filter("tokenizer = 'blank-1'").join(poor, "doc_id", "left_semi").join(new, "doc_id")
    revised = revised.select(F.lit("revise").alias("change"), *KEYS, F.col("new").alias("tokens"), F.col("tokens").alias("old_tokens"))
    for _ in range(2):
        ledger.commit("3-revised", revised)
    return ledger.totals()


LEDGER_SQL = r"""
WITH c AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS blank,
         coalesce(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+')), 0) AS alnum
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens FROM (
  SELECT source, lang, 'blank-1' AS tokenizer, CASE WHEN r.doc_id IS NULL THEN blank ELSE alnum END AS tokens FROM c LEFT JOIN r USING (doc_id)
  UNION ALL SELECT source, lang, 'alnum-1', alnum FROM c)
GROUP BY ALL
"""
