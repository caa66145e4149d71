"""The pipeline's stages on the smallest tables, each against what its operator says of its own input."""

import corpus_pipeline
from quillspark.llm import line_dedup, mixing, phrase_index, quality_rules, simhash
from quillspark.llm.workspace import Workspace


def test_stages(spark, sf):
    ws = Workspace(spark, "test")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("benchmark", "labels"))
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(ws.table(stage(spark, seen[-1], sf)))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    rules = quality_rules.fit(docs, labels)
    assert ids[1] == {r.doc_id for r in quality_rules.judge(docs, rules).collect() if r.kept}
    gone = {r.doc_id: set(r.dropped) for r in line_dedup.digest(seen[1]).collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in seen[1:3])
    assert after == {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in before.items()}
    assert ids[3] == {r.component_id for r in simhash.near_duplicates(seen[2]).collect()}
    hit = {r.doc_id for r in phrase_index.contamination(seen[3], bench).collect() if r.n_hit}
    assert hit and ids[4] == ids[3] - hit
    plan = {r.doc_id: r.taken for r in mixing.mix(seen[4]).collect()}
    assert {r.doc_id: r.taken for r in seen[5].collect()} == {k: v for k, v in plan.items() if v}
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, seen[5].collect()))


def shared_ids(spark):
    """Rows of different texts under a null id and under one number, some of them copies."""
    word = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(None, word(1, 80)), (None, word(2, 80)), (None, word(1, 80)), (7, word(3, 80)), (7, word(4, 80)), (8, word(4, 80)), (3, word(2, 80))]
    return word, spark.createDataFrame(rows, "doc_id long, text string")


def test_near_dedup_of_shared_ids(spark):
    word, docs = shared_ids(spark)
    got = corpus_pipeline._near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, word(1, 80)), (3, word(2, 80)), (7, word(3, 80)), (7, word(4, 80))])


def test_line_dedup_of_shared_ids(spark):
    word, _ = shared_ids(spark)
    one, two, three = (word(k, 12) for k in (1, 2, 3))
    # The first line of (1) is also that of a null id's row, whose number another null id's row has a line of its own at.
    texts = [(1, one), (None, f"{one}\n{two}"), (None, f"{three}\n{word(4, 12)}"), (9, f"{word(5, 12)}\n{word(6, 12)}"), (9, f"{word(7, 12)}\n{word(6, 12)}")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs).collect())
    kept = [x for _, t in got for x in t.split("\n")]
    assert sorted(kept) == sorted([one, two, three, *(word(k, 12) for k in (4, 5, 6, 7))])
    assert (0, two) in got and (0, texts[2][1]) in got
    assert sorted(r.n_dropped for r in line_dedup.digest(docs).collect()) == [0, 0, 0, 1, 1]
