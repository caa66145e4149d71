"""Benchmark decontamination on a distributed positional inverted index (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .ids import loose, solid
from .workspace import Workspace

#: So many test terms at most are handed to the index tasks (8 bytes each); with more, every term is indexed.
MAX_VOCABULARY = 500_000
CHUNK = 4 << 20


def _tokens(data: np.ndarray, offsets: np.ndarray):
    data = kernels.LOWER[data]
    starts, ends, first = kernels.runs(data, offsets, kernels.ALNUM)
    return data, starts, ends, first


def item_words(items: DataFrame) -> DataFrame:
    """(uid, item_id, n, pos, term, word) for every word of every test item; uid names an item's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, item = batch.column("uid"), batch.column("item_id")
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text"), CHUNK):
                data, starts, ends, first = _tokens(data, offsets)
                n = np.diff(first)
                row = pa.array(np.repeat(np.arange(lo, hi), n))
                raw = data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
                terms = kernels.run_hashes(data, starts, ends).view(np.int64)
                pos = np.arange(len(starts)) - np.repeat(first[:-1], n)
                yield pa.RecordBatch.from_arrays([uid.take(row), item.take(row), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(pos.astype(np.int32)), pa.array(terms), pa.array(words, pa.string())], ["uid", "item_id", "n", "pos", "term", "word"])

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL").distinct()
    return rows.withColumn("uid", F.xxhash64("item_id", "text")).mapInArrow(run, "uid long, item_id long, n int, pos int, term long, word string")


def build_index(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """Posting lists (term, n, docs, at) of each slice of the documents: parallel arrays of doc_id and word position.

    With ``vocabulary`` (sorted int64 term hashes), only for its terms. A row without a term lists the
    slice's documents and their word counts.
    """
    known = None
    if vocabulary is not None:
        known = np.zeros(1 << 20, bool)
        known[vocabulary & 0xFFFFF] = True

    def lists(keys: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.append(first, len(keys)), ids[order], at[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text"), CHUNK):
                data, starts, ends, first = _tokens(data, offsets)
                n = np.diff(first)
                terms = kernels.run_hashes(data, starts, ends).view(np.int64)
                row = np.repeat(np.arange(hi - lo), n)
                pos = (np.arange(len(starts)) - first[:-1][row]).astype(np.int32)
                if known is not None:
                    hit = np.flatnonzero(known[terms & 0xFFFFF])
                    if len(vocabulary) and len(hit):
                        found = np.minimum(np.searchsorted(vocabulary, terms[hit]), len(vocabulary) - 1)
                        hit = hit[vocabulary[found] == terms[hit]]
                    terms, row, pos = terms[hit], row[hit], pos[hit]
                keys, cuts, who, at = lists(terms, ids[lo:hi][row], pos)
                keys = pa.array(np.append(keys, 0), mask=np.append(np.zeros(len(keys), bool), True))
                cuts = np.append(cuts, cuts[-1] + hi - lo).astype(np.int32)
                who, at = np.concatenate([who, ids[lo:hi]]), np.concatenate([at, n.astype(np.int32)])
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(cuts)), pa.ListArray.from_arrays(cuts, pa.array(who, pa.int64())), pa.ListArray.from_arrays(cuts, pa.array(at, pa.int32()))], ["term", "n", "docs", "at"])

    return docs.select(solid(), F.col("text").cast("string")).mapInArrow(run, "term long, n int, docs array<long>, at array<int>")


def candidates(index: DataFrame, words: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """(uid, doc_id, diag): places where an item's words may stand, word 0 at position diag.

    Each window looks up its rarest term's list and intersects it with that of its second rarest term,
    both less their offsets in the item; the offsets may differ by ``slop`` words.
    """
    counts = index.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("cf"))
    ranked = words.join(counts, "term", "left").withColumn("e", F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "pos", "term"))
    frame = Window.partitionBy("uid").orderBy("pos").rowsBetween(0, window - 1)
    rare = ranked.withColumn("two", F.slice(F.array_sort(F.collect_list("e").over(frame)), 1, 2)).filter(F.col("pos") <= F.greatest(F.col("n") - window, F.lit(0)))
    a, b = F.element_at("two", 1), F.element_at("two", -1)
    anchors = rare.select("uid", a.pos.alias("a_pos"), a.term.alias("term"), b.pos.alias("b_pos"), b.term.alias("b_term")).distinct()
    needed = anchors.select("term").union(anchors.select("b_term")).distinct()
    postings = index.join(needed, "term").select("term", F.explode(F.arrays_zip("docs", "at")).alias("p")).select("term", F.col("p.docs").alias("doc_id"), F.col("p.at").alias("at"))
    at = anchors.join(postings, "term").select("uid", "doc_id", "b_term", (F.col("at") - F.col("a_pos")).alias("diag"), "b_pos")
    second = postings.select(F.col("term").alias("b_term"), "doc_id", F.col("at").alias("b_at"))
    if slop == 0:
        both = at.withColumn("b_at", F.col("diag") + F.col("b_pos")).join(second, ["b_term", "doc_id", "b_at"])
    else:
        near = at.withColumn("want", F.col("diag") + F.col("b_pos")).withColumn("cell", F.explode(F.array(*(F.floor(F.col("want") / (slop + 1)) + i for i in (-1, 0, 1)))))
        both = near.join(second.withColumn("cell", F.floor(F.col("b_at") / (slop + 1))), ["b_term", "doc_id", "cell"]).filter(F.abs(F.col("b_at") - F.col("want")) <= slop)
    return both.select("uid", "doc_id", "diag").distinct()


def exact_hits(rows: DataFrame, window: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of rows (doc_id, text, places); a place is (item_id, diags, words). ``keys``: string columns that stay."""
    names = ["doc_id", *keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column("places")
            out_n, out_hit, out_items = [], [], []
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text")):
                data, starts, ends, first = _tokens(data, offsets)
                raw = data.tobytes()
                for i in range(lo, hi):
                    s, e = starts[first[i - lo] : first[i - lo + 1]].tolist(), ends[first[i - lo] : first[i - lo + 1]].tolist()
                    hit, items = np.zeros(len(s) + 1, np.int64), set()
                    for p in places[i].as_py():
                        words = [w.encode() for w in p["words"]]
                        size = min(window, len(words))
                        for diag in p["diags"]:
                            run_from = None
                            for k in range(len(words) + 1):
                                at = diag + k
                                same = k < len(words) and 0 <= at < len(s) and raw[s[at] : e[at]] == words[k]
                                if same and run_from is None:
                                    run_from = at
                                elif not same and run_from is not None:
                                    if at - run_from >= size:
                                        hit[run_from] += 1
                                        hit[at] -= 1
                                        items.add(p["item_id"])
                                    run_from = None
                    out_n.append(len(s))
                    out_hit.append(int((np.cumsum(hit)[:-1] > 0).sum()))
                    out_items.append(sorted(items - {None}))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out_n, pa.int64()), pa.array(out_hit, pa.int64()), pa.array(out_items, pa.list_(pa.int64()))], [*names, "n_words", "n_hit", "items"])

    return rows.select(*names, "text", "places").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} string" for c in keys), "n_words long, n_hit long, items array<long>"]))


def _vocabulary(words: DataFrame) -> np.ndarray | None:
    """The items' terms, sorted, if they are few enough to be sent to every task."""
    terms = words.select("term").distinct()
    if terms.count() > MAX_VOCABULARY:
        return None
    return np.sort(np.array([r[0] for r in terms.collect()], np.int64))


def _matched(docs: DataFrame, items: DataFrame, window: int, ws: Workspace, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The exact hits of the rows where an item may stand, the index, and the doc_ids of those rows."""
    words = ws.table(item_words(items))
    index = ws.table(build_index(docs, _vocabulary(words)))
    found = ws.table(candidates(index, words, window))
    texts = words.groupBy("uid").agg(F.first("item_id").alias("item_id"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word).alias("words"))
    at = found.groupBy("doc_id", "uid").agg(F.collect_list("diag").alias("diags"))
    places = at.join(texts, "uid").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diags", "words")).alias("places"))
    rows = docs.select(solid(), *keys, F.col("text").cast("string")).join(places, "doc_id")
    return exact_hits(rows, window, keys), index, found.select("doc_id").distinct()


def hit_rows(docs: DataFrame, items: DataFrame, keys: tuple[str, ...] = (), window: int = 10) -> DataFrame:
    """(doc_id, *keys) of the rows of ``docs`` with a word inside an exact occurrence of a window; a null doc_id as the largest."""
    ws = Workspace(docs.sparkSession, "phrases")
    hits, *_ = _matched(docs, items, window, ws, keys)
    out = ws.table(hits.filter("n_hit > 0").select("doc_id", *keys))
    ws.drop_all_but(out)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Each document's words inside exact occurrences of the items' windows.

    Columns doc_id, n_words, n_hit, items (their ids, sorted). Null, empty and wordless texts have no words
    and no hits; items without words have no windows; an item of fewer words than ``window`` is one window.
    Repeated rows of documents each give a row; repeated items count once. A null item_id is left out of
    ``items``. Other columns are ignored. With either table empty nothing is hit.
    """
    ws = Workspace(docs.sparkSession, "phrases")
    hits, index, found = _matched(docs, items, window, ws, ())
    sizes = index.filter("term IS NULL").select(F.explode(F.arrays_zip("docs", "at")).alias("p")).select(F.col("p.docs").alias("doc_id"), F.col("p.at").cast("long").alias("n_words"))
    clean = sizes.join(found, "doc_id", "left_anti")
    out = hits.unionByName(clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<long>").alias("items")))
    return out.select(loose(), "n_words", "n_hit", "items")


def near_hits(rows: DataFrame, window: int, slop: int) -> DataFrame:
    """(doc_id, uid) of rows (doc_id, text, places) whose text holds a near match of the place's item; a place is (uid, diags, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id"), batch.column("places")
            row, found = [], []
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text")):
                data, starts, ends, first = _tokens(data, offsets)
                raw = data.tobytes()
                for i in range(lo, hi):
                    at: dict[bytes, list[int]] = {}
                    for p, (s, e) in enumerate(zip(starts[first[i - lo] : first[i - lo + 1]].tolist(), ends[first[i - lo] : first[i - lo + 1]].tolist())):
                        at.setdefault(raw[s:e], []).append(p)
                    for place in places[i].as_py():
                        start = np.unique(np.add.outer(place["diags"], np.arange(-slop, slop + 1)))
                        run_of = np.zeros(len(start), np.int64)  # item words in a row that stand near their place, by start
                        need = min(window, len(place["words"]))
                        for k, word in enumerate(place["words"]):
                            stands = np.array(at.get(word.encode(), [1 << 60]))
                            nearest = stands[np.minimum(np.searchsorted(stands, start + k - slop), len(stands) - 1)]
                            run_of = np.where(np.abs(nearest - start - k) <= slop, run_of + 1, 0)
                            if (run_of >= need).any():
                                row.append(i)
                                found.append(place["uid"])
                                break
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "uid"])

    return rows.select("doc_id", "text", "places").mapInArrow(run, "doc_id long, uid long")


def proximity(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 2) -> DataFrame:
    """(doc_id, item_id), each once: documents that hold a window of an item, each of its words at most ``slop`` words from its place.

    A near match has a start, and the item's k-th word stands within ``slop`` words of start + k, for
    ``window`` words in a row (all of a shorter item). So words may change places, go in between or be
    left out by as much as that shifts. In any near match the places of two words, less their offsets,
    differ by twice ``slop`` at most, so the lists of the window's two rarest terms give all candidates;
    each is then checked against the text. Null and wordless texts and items match nothing. Other columns
    are ignored. With either table empty nothing matches.
    """
    ws = Workspace(docs.sparkSession, "proximity")
    words = ws.table(item_words(items))
    index = ws.table(build_index(docs, _vocabulary(words)))
    found = ws.table(candidates(index, words, window, 2 * slop))
    texts = words.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x.word).alias("words"))
    at = found.groupBy("doc_id", "uid").agg(F.collect_list("diag").alias("diags"))
    places = at.join(texts, "uid").groupBy("doc_id").agg(F.collect_list(F.struct("uid", "diags", "words")).alias("places"))
    rows = docs.select(solid(), F.col("text").cast("string")).join(places, "doc_id")
    hits = near_hits(rows, window, slop).join(words.select("uid", "item_id").distinct(), "uid")
    return hits.select(loose(), "item_id").distinct()


NEAR_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS k FROM i),
s AS (SELECT DISTINCT doc_id, item_id, n, k, p - k + e AS start FROM dw JOIN iw USING (word), (SELECT unnest(range(-2, 3)) AS e)),
g AS (SELECT doc_id, item_id, n, k - row_number() OVER (PARTITION BY doc_id, item_id, start ORDER BY k) AS island, start FROM s)
SELECT DISTINCT doc_id, item_id FROM g GROUP BY doc_id, item_id, n, start, island HAVING count(*) >= least(n, 10)
"""
