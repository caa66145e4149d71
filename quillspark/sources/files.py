"""Files of other kinds: graphs as node-link JSON and GraphML, folders of PDF files, chunks by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key:string,_VALUE:string>>"


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, attributes) and edges (src, dst, attributes) of node-link JSON; edges stand under ``links`` or ``edges``.

    Attributes are a map of texts without the ids. A file without nodes or edges gives none.
    """
    rows = spark.read.schema("nodes array<map<string,string>>, links array<map<string,string>>, edges array<map<string,string>>").json(path, multiLine=True)
    nodes = rows.select(F.explode("nodes").alias("m"))
    edges = rows.select(F.explode(F.coalesce("links", "edges")).alias("m"))
    rest = lambda *names: F.map_filter("m", lambda k, _: ~k.isin(*names))
    return nodes.select(F.col("m")["id"].alias("node"), rest("id").alias("attributes")), edges.select(F.col("m")["source"].alias("src"), F.col("m")["target"].alias("dst"), rest("source", "target").alias("attributes"))


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, attributes) and edges (src, dst, attributes) of a GraphML file, attributes under their names.

    The names of attributes, which the file declares at its head, come to all tasks as one row.
    """
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    keys = read("key", "_id string, `_attr.name` string").filter("_id IS NOT NULL")
    names = keys.agg(F.map_from_entries(F.collect_list(F.struct("_id", F.col("`_attr.name`").alias("name")))).alias("names"))

    def attributes(rows: DataFrame) -> DataFrame:
        data = F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(F.coalesce(F.col("names")[d["_key"]], d["_key"]).alias("k"), d["_VALUE"].alias("v")))
        return rows.crossJoin(F.broadcast(names)).withColumn("attributes", F.map_from_entries(data))

    nodes = attributes(read("node", f"_id string, {_DATA}")).select(F.col("_id").alias("node"), "attributes")
    edges = attributes(read("edge", f"_source string, _target string, {_DATA}")).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), "attributes")
    return nodes, edges


def pdf_files(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(name, length, path) of a folder's PDF files in order of name, the first ``most`` of them; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "path").orderBy("name")
    return rows if most is None else rows.limit(most)


def write_chunks(chunks: DataFrame, path: str, by: str = "source") -> None:
    """Chunks as JSON lines, a folder for each source; the commit of the write makes all of it visible at once."""
    chunks.write.mode("overwrite").partitionBy(by).json(path)
