"""Sources and sinks: parquet tables, question sets, vectors with a dimension check, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files that one task of ``spread`` gets, about.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files are fewer than they are: a file's row groups, which one task each reads, may be one.

    Large files are dealt over more tasks than cores, so that a task's share doesn't grow with them.
    """
    spark, files = df.sparkSession, df.inputFiles()
    cores = spark.sparkContext.defaultParallelism
    if len(files) >= cores:
        return df
    paths = [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f)) for f in files]
    size = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)
    return df.repartition(max(cores, -(-size // SPREAD_BYTES)))


def vectors(spark: SparkSession, path: str, column: str, dim: int) -> DataFrame:
    """Vectors of one dimension; a row of another fails the job."""
    df = spark.read.parquet(path)
    same = F.size(column) == dim
    return df.filter(F.when(same, True).otherwise(F.raise_error(F.lit(f"{column} is not of dimension {dim}")).cast("boolean")))


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, category) from JSON with a ``questions`` array, or from text, a question a line, # for comments."""
    if path.endswith(".json"):
        schema = "questions array<struct<id:string,question:string,category:string>>"
        return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")
    lines = spark.read.text(path).select(F.trim("value").alias("question")).filter("question <> '' AND NOT startswith(question, '#')")
    return lines.select(F.md5("question").alias("id"), "question", F.lit(None).cast("string").alias("category"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line; the commit of the write makes the whole output visible at once."""
    df.write.mode("overwrite").json(path)
