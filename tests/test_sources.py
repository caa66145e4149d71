"""Sources and sinks on small files."""

import json

import pytest

from quillspark.sources import files, tables


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "1", "question": "what?", "category": "a"}, {"id": "2", "question": "who?"}]}))
    assert sorted(map(tuple, tables.questions(spark, f"{tmp_path}/q.json").collect())) == [("1", "what?", "a"), ("2", "who?", None)]
    (tmp_path / "q.txt").write_text("# no\n\n first \nsecond\n")
    assert sorted(r.question for r in tables.questions(spark, f"{tmp_path}/q.txt").collect()) == ["first", "second"]


def test_vectors_of_one_dimension(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "i int, v array<double>").write.parquet(f"{tmp_path}/v")
    assert tables.vectors(spark, f"{tmp_path}/v", "v", 2).count() == 2
    with pytest.raises(Exception, match="not of dimension 3"):
        tables.vectors(spark, f"{tmp_path}/v", "v", 3).collect()


def test_json_lines(spark, tmp_path):
    rows = [(1, "a", ["x", "y"]), (2, None, [])]
    df = spark.createDataFrame(rows, "i int, t string, xs array<string>")
    tables.write_json_lines(df, f"{tmp_path}/out")
    assert sorted(map(tuple, spark.read.schema(df.schema).json(f"{tmp_path}/out").collect())) == rows


def test_spread(spark, sf):
    few = tables.table(spark, sf, "documents")
    assert sorted(map(str, tables.spread(few).collect())) == sorted(map(str, few.collect()))
    assert tables.spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_graph_json(spark, tmp_path):
    graph = {"directed": True, "nodes": [{"id": "a", "type": "x", "n": 3}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "r"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph, indent=1))
    nodes, edges = files.graph_json(spark, f"{tmp_path}/g.json")
    assert {r.node: r.attributes for r in nodes.collect()} == {"a": {"type": "x", "n": "3"}, "b": {}}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", {"relation": "r"})]
    (tmp_path / "e.json").write_text(json.dumps({"nodes": [], "edges": [{"source": "a", "target": "c"}]}))
    nodes, edges = files.graph_json(spark, f"{tmp_path}/e.json")
    assert nodes.collect() == [] and [tuple(r) for r in edges.collect()] == [("a", "c", {})]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text("""<?xml version='1.0' encoding='utf-8'?>
<graphml><key id="d1" for="edge" attr.name="relation" attr.type="string"/><key id="d0" for="node" attr.name="type" attr.type="string"/>
<graph edgedefault="directed"><node id="n 1"><data key="d0">article</data></node><node id="n2"/>
<edge source="n 1" target="n2"><data key="d1">refers &amp; cites</data></edge><edge source="n2" target="n2"/></graph></graphml>""")
    nodes, edges = files.graphml(spark, f"{tmp_path}/g.graphml")
    assert {r.node: r.attributes for r in nodes.collect()} == {"n 1": {"type": "article"}, "n2": {}}
    assert sorted((r.src, r.dst, tuple(r.attributes.items())) for r in edges.collect()) == [("n 1", "n2", (("relation", "refers & cites"),)), ("n2", "n2", ())]


def test_pdf_files_and_chunks(spark, tmp_path):
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / n).write_bytes(b"12345")
    assert [(r.name, r.length) for r in files.pdf_files(spark, str(tmp_path)).collect()] == [("a.pdf", 5), ("b.pdf", 5)]
    assert [r.name for r in files.pdf_files(spark, str(tmp_path), 1).collect()] == ["a.pdf"]
    chunks = spark.createDataFrame([("s", 0, "x"), ("t", 0, "y"), ("s", 1, "z")], "source string, i int, body string")
    files.write_chunks(chunks, f"{tmp_path}/chunks")
    assert sorted((r.source, r.i, r.body) for r in spark.read.json(f"{tmp_path}/chunks").collect()) == [("s", 0, "x"), ("s", 1, "z"), ("t", 0, "y")]
