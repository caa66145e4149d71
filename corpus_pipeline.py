"""The corpus pipeline: quality rules, line dedup, near-duplicates, benchmark decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import line_dedup, mixing, phrase_index, quality_rules, simhash
from quillspark.llm.ids import keyed, loose, solid
from quillspark.llm.workspace import Workspace


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a learned rule rejects."""
    return quality_rules.keep(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that near-copy an earlier one."""
    return line_dedup.dedup_lines(docs)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group."""
    return simhash.first_rows(docs)


def _decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window; rows of one doc_id are judged apart."""
    rows = keyed(docs, Workspace(spark, "rows"))
    hit = phrase_index.hit_rows(rows.select("doc_id", "key", "row.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("key",))
    return rows.join(hit, ["doc_id", "key"], "left_anti").select("row.*")


def _mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, and how many, with their other columns but for those that the mix names. The mix decides on slim rows; whole rows are joined to what it takes."""
    rows = keyed(docs, Workspace(spark, "rows"))
    slim = rows.select(loose(), F.col("key").alias("row_key"), "row.source", "row.text")
    plan = mixing.mix(slim, carry=("row_key",)).filter("taken > 0")
    plan = Workspace(spark, "plan").table(plan.select(solid(), F.col("row_key").alias("key"), "size", "source_size", "target", "taken"))
    carried = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "size", "source_size", "target", "taken")]
    # A row of the plan for each document kept, so joined by a shuffle at every size.
    return rows.join(plan.hint("merge"), ["doc_id", "key"]).select(loose(), *carried, "size", "source_size", "target", "taken")


STAGES = [
    ("quality_rules", _quality),
    ("line_dedup", _lines),
    ("simhash_near_dedup", _near_duplicates),
    ("decontamination", _decontaminated),
    ("mixing", _mixed),
]

#: Learned rules, MinHash and SimHash stages can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.table(docs)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
