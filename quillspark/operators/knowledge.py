"""Knowledge graphs from chunks, entities and relations; graphs that grow node by node."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scores import haversine
from quillspark.functions.text import fold

from .graphs import cut

#: Weights of the edges of a property graph, by relation; any other relation has 1.
WEIGHTS = {"has_section": 0.8, "has_chunk": 0.7, "mentioned_in": 0.6, "contains_entity": 0.6, "is_type": 0.5, "co_occurs_with": 0.9}
#: Entities of a chunk that count, the first ones.
PER_CHUNK = 20
#: The type of an end of a relation that no chunk names as an entity.
UNKNOWN = "CONCEPT"


def entity_name(name: Column) -> Column:
    """A name without punctuation around it and with single blanks."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"^[.,;:\"'()\[\]]+|[.,;:\"'()\[\]]+$", ""), r"\s+", " ")


def named_entities(entities: DataFrame) -> DataFrame:
    """(chunk, pos, key, name, kind): the first ``PER_CHUNK`` named entities (chunk, pos, name, kind) of each chunk.

    Names that fold alike are one entity, whose key is the folded name.
    """
    rows = entities.select("chunk", "pos", entity_name(F.col("name")).alias("name"), F.upper(F.trim(F.coalesce("kind", F.lit("")))).alias("kind")).filter("name <> ''")
    w = Window.partitionBy("chunk").orderBy("pos", "name")
    rows = rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= PER_CHUNK).drop("turn")
    return rows.withColumn("key", fold(F.col("name")))


def entity_nodes(mentions: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, name, kind): an entity's first name in order of chunk and place, and its first kind that isn't empty.

    ``ends`` (chunk, pos, key, name) are ends of relations; what no mention (chunk, pos, key, name, kind)
    names is an entity of ``UNKNOWN`` kind.
    """
    order = F.struct(F.lit(0).alias("late"), "chunk", "pos", "name")
    rows = mentions.select("key", "name", "kind", order.alias("order")).unionByName(ends.select("key", "name", F.lit(UNKNOWN).alias("kind"), F.struct(F.lit(1).alias("late"), "chunk", "pos", "name").alias("order")))
    first = rows.groupBy("key").agg(F.min_by("name", "order").alias("name"), F.min_by("kind", F.when(F.col("kind") != "", F.col("order"))).alias("kind"), F.min("order.late").alias("late"))
    # What was mentioned without a kind keeps none, even if it ends a relation.
    mentioned = mentions.groupBy("key").agg(F.max(F.col("kind") != "").alias("typed"))
    return first.join(mentioned, "key", "left").select("key", "name", F.when((F.col("late") == 0) & ~F.coalesce("typed", F.lit(False)), "").otherwise(F.coalesce("kind", F.lit(""))).alias("kind"))


def property_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The nodes (node, kind, name, type) and edges (src, relation, dst, weight) of chunks and what is found in them.

    ``chunks`` is (chunk, source, section), ``entities`` (chunk, pos, name, kind), ``relations`` (chunk, pos,
    subject, relation, object). Documents have sections, sections (or documents, without one) chunks; chunks
    and their entities point at each other; entities of a chunk occur together, in both directions; entities
    have their kinds. A relation stays if its ends are two names and an entity of any chunk is one of them.
    Each edge and node stands once. A null or blank section is none; chunk names are unique.
    """
    has_section = F.trim(F.coalesce("section", F.lit(""))) != ""
    doc, chunk = F.concat(F.lit("doc::"), "source"), F.concat(F.lit("chunk::"), F.col("chunk").cast("string"))
    section = F.concat(F.lit("section::"), "source", F.lit("::"), F.left("section", F.lit(80)))
    entity = lambda c: F.concat(F.lit("entity::"), c)
    mentions = named_entities(entities)
    ends = relations.select("chunk", "pos", entity_name(F.col("subject")).alias("s"), F.trim("relation").alias("relation"), entity_name(F.col("object")).alias("o")).filter("s <> '' AND o <> '' AND relation <> ''")
    ends = ends.withColumns({"s_key": fold(F.col("s")), "o_key": fold(F.col("o"))}).filter("s_key <> o_key")
    known = mentions.select("key").distinct()
    kept = ends.join(known.select(F.col("key").alias("s_key"), F.lit(True).alias("s_known")), "s_key", "left").join(known.select(F.col("key").alias("o_key"), F.lit(True).alias("o_known")), "o_key", "left").filter("s_known OR o_known")
    both = kept.select("chunk", "pos", F.col("s_key").alias("key"), F.col("s").alias("name")).unionByName(kept.select("chunk", "pos", F.col("o_key").alias("key"), F.col("o").alias("name")))
    found = entity_nodes(mentions, both)
    node = lambda df, n, kind, name, kind_of=F.lit(None).cast("string"): df.select(n.alias("node"), F.lit(kind).alias("kind"), name.alias("name"), kind_of.alias("type"))
    kinds = found.filter("kind <> ''")
    nodes = node(chunks, doc, "document", F.col("source")).distinct()
    nodes = nodes.unionByName(node(chunks.filter(has_section), section, "section", F.left("section", F.lit(80))).distinct())
    nodes = nodes.unionByName(node(chunks, chunk, "chunk", F.col("chunk").cast("string")))
    nodes = nodes.unionByName(node(found, entity(F.col("key")), "entity", F.col("name"), F.nullif(F.col("kind"), F.lit(""))))
    nodes = nodes.unionByName(node(kinds, F.concat(F.lit("type::"), "kind"), "entity_type", F.col("kind")).distinct())
    edge = lambda df, a, relation, b: df.select(a.alias("src"), relation.alias("relation"), b.alias("dst"))
    in_chunk = mentions.select("chunk", "key").distinct()
    a, b = in_chunk.withColumnRenamed("key", "a"), in_chunk.withColumnRenamed("key", "b")
    edges = edge(chunks.filter(has_section), doc, F.lit("has_section"), section)
    edges = edges.unionByName(edge(chunks, F.when(has_section, section).otherwise(doc), F.lit("has_chunk"), chunk))
    edges = edges.unionByName(edge(in_chunk, entity(F.col("key")), F.lit("mentioned_in"), chunk)).unionByName(edge(in_chunk, chunk, F.lit("contains_entity"), entity(F.col("key"))))
    edges = edges.unionByName(edge(kinds, entity(F.col("key")), F.lit("is_type"), F.concat(F.lit("type::"), "kind")))
    edges = edges.unionByName(edge(a.join(b, "chunk").filter("a <> b"), entity(F.col("a")), F.lit("co_occurs_with"), entity(F.col("b"))))  # PER_CHUNK a chunk at most
    edges = edges.unionByName(edge(kept, entity(F.col("s_key")), F.col("relation"), entity(F.col("o_key"))))
    known_weights = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return nodes, edges.distinct().withColumn("weight", F.coalesce(F.element_at(known_weights, F.col("relation")), F.lit(1.0)))


#: What ``neighbourhoods`` gives of a node.
DERIVED = "node string, degree long, length double, mean array<double>"


def neighbourhoods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree, length, mean) of each node (node, lat, lon, features): its edges, their summed lengths, and the mean features of its neighbours.

    ``edges`` (u, v, length) stand once and hold in both directions. A node without edges has degree 0 and
    its own features as mean. Neighbours are added from the greatest name down (longer names are greater), so a
    mean doesn't hang on the order in which rows arrive.
    """
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other"), "length").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other"), "length"))
    near = both.join(nodes.select(F.col("node").alias("other"), "features"), "other")
    sums = near.groupBy("node").agg(F.count("*").alias("degree"), F.round(F.sum("length"), 2).alias("length"))
    w = Window.partitionBy("node", "i").orderBy(F.desc(F.length("other")), F.desc("other"))
    parts = near.select("node", "other", F.posexplode("features").alias("i", "x"))
    parts = parts.select("node", "i", F.row_number().over(w).alias("turn"), F.sum("x").over(w).alias("s"), F.count("x").over(w).alias("n"))  # a name stands once, so ranges are rows
    parts = parts.groupBy("node", "i").agg(F.max_by(F.col("s") / F.col("n"), "turn").alias("x"))
    mean = parts.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    rows = nodes.select("node", "features").join(sums, "node", "left").join(mean, "node", "left")
    return rows.select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("length", F.lit(0.0)).alias("length"), F.coalesce("mean", "features").alias("mean"))


def add_nodes(nodes: DataFrame, edges: DataFrame, derived: DataFrame, new: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and derived rows after new nodes (node, lat, lon, features) and their links (node, other).

    A node that is there stays as it is, and its links are none; of repeated new rows one counts. A link to a
    node that isn't there, or to itself, is none. An edge is as long as its ends are apart, in metres to the
    centimetre. Only new nodes and those that they link to are worked out anew; all others keep their rows.
    What is new and touched is written, as all results read it.
    """
    fresh = cut(new.select("node", "lat", "lon", "features").join(nodes.select("node"), "node", "left_anti").dropDuplicates(["node"]))
    every = nodes.unionByName(fresh)
    at = every.select("node", "lat", "lon")
    pairs = links.join(fresh.select("node"), "node", "left_semi").filter("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    ends = pairs.join(at.toDF("u", "ulat", "ulon"), "u").join(at.toDF("v", "vlat", "vlon"), "v")
    added = cut(ends.select("u", "v", F.round(haversine(F.col("ulat"), F.col("ulon"), F.col("vlat"), F.col("vlon")), 2).alias("length")))
    all_edges = edges.unionByName(added)
    touched = cut(fresh.select("node").union(added.select("u")).union(added.select("v")).distinct())
    # The touched nodes' edges and those edges' other ends are all that their rows depend on.
    mine = all_edges.join(touched.withColumnRenamed("node", "u"), "u", "left_semi").unionByName(all_edges.join(touched.withColumnRenamed("node", "v"), "v", "left_semi").join(touched.withColumnRenamed("node", "u"), "u", "left_anti"))
    mine = cut(mine.select("u", "v", "length"))
    around = mine.select(F.col("u").alias("node")).union(mine.select("v")).union(touched).distinct()
    again = neighbourhoods(every.join(around, "node", "left_semi"), mine).join(touched, "node", "left_semi")
    return every, all_edges, derived.join(touched, "node", "left_anti").unionByName(again)
