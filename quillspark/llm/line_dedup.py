"""Line deduplication: fuzzy lines by MinHash, exact Jaccard and distributed union-find (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .components import connected
from .ids import keyed, loose
from .workspace import Workspace

SHINGLE, SIMILARITY = 5, 0.8
#: 12 bands of 5 minima: lines at Jaccard 0.8 share one with probability 0.991, at 0.85 with 0.999.
BANDS, ROWS = 12, 5
#: A band key with so many lines in a sample of 1 in SAMPLE is hot, and its lines are dealt over SALTS groups.
SAMPLE, HOT, SALTS, MOST_HOT = 64, 64, 64, 10_000
#: 64-bit words of a line's shingle parities.
PARITY_WORDS = 16
#: Lines of a block where a group's classes are held against each other.
BLOCK = 1024
#: Names of lines that a task remembers.
MOST_SEEN = 1 << 20
#: The filter for the lines whose text is compared has so many bits a line, in a power of two between these bounds (128 KB to 128 MB).
FILTER_SHARE, LEAST_BITS, MOST_BITS = 16, 20, 30
_U = np.uint64


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Code points of a slice, spans of its lines that have a word, each line's document and number in it."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum(kernels.HEAD[data])])
    at = heads[offsets]
    breaks = points == 10
    starts, ends, first = kernels.runs_of(~breaks, at)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    n_breaks = np.concatenate([[0], np.cumsum(breaks)])
    number = n_breaks[starts] - n_breaks[at[:-1]][doc]
    inked = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
    full = inked[ends] > inked[starts]
    return points, starts[full], ends[full], doc[full], number[full].astype(np.int32)


def _hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lines' shingles (a shorter line is one shingle), and each line's first."""
    factor = [_U(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(SHINGLE)]
    key = np.zeros(len(points), _U)
    wide = points.astype(_U) + _U(1)
    for j in range(SHINGLE):
        key[: len(points) - j] += wide[j:] * factor[j]
    n = np.maximum(ends - starts - SHINGLE + 1, 1)
    first = np.concatenate([[0], np.cumsum(n)])
    place = np.arange(first[-1]) + np.repeat(starts - first[:-1], n)
    out = key[place]
    short = np.flatnonzero(ends - starts < SHINGLE)
    out[first[short]] = sum((np.where(ends[short] - starts[short] > j, wide[np.minimum(starts[short] + j, len(points) - 1)] * factor[j], _U(0)) for j in range(SHINGLE)), np.zeros(len(short), _U))
    return kernels.mixed(out), first


def _names(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each line's text: of its characters, and of its shingles in order."""
    k1 = kernels.run_hashes(points, starts, ends)
    place = np.arange(len(hashes), dtype=_U) - np.repeat(first[:-1], np.diff(first)).astype(_U)
    return k1, kernels.mixed(np.add.reduceat(kernels.mixed(hashes + place), first[:-1]) ^ k1)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, int]:
    """Each line's distinct shingles, sorted: the line's number in the high bits, so many low bits of hash."""
    n = len(first) - 1
    low = 64 - n.bit_length()
    both = np.sort((np.repeat(np.arange(n, dtype=_U), np.diff(first)) << _U(low)) | (hashes >> _U(64 - low)))
    return both[np.append(True, both[1:] != both[:-1])] if len(both) else both, low


def _parities(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's number of distinct shingles, and for each of ``PARITY_WORDS`` * 64 cells whether an odd number of them falls in it."""
    n, bits = len(first) - 1, (PARITY_WORDS * 64).bit_length() - 1
    both, low = _distinct(hashes, first)
    line = both >> _U(low)
    cells = both >> _U(low - bits)  # a shingle's cell: the highest bits of its hash, so still in order
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    odd = cells[at[(np.diff(np.append(at, len(cells))) & 1).astype(bool)]]
    words = (odd >> _U(6)).astype(np.int64)
    out = np.zeros(n * PARITY_WORDS, _U)
    if len(odd):
        head = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        out[words[head]] = np.bitwise_or.reduceat(_U(1) << (odd & _U(63)), head)
    return np.bincount(line.astype(np.int64), minlength=n).astype(np.int32), out.reshape(n, PARITY_WORDS)


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, key, line, k1, k2, n, odd, bands) of every line with a word of keyed rows; k1 and k2 together name its exact text.

    Of several equal lines in a task only the first has bands, its number of distinct shingles and their
    parities. Each minimum is over the shingles' hashes times an odd number plus another, modulo 2^32, both
    drawn anew for each.
    """
    rng = np.random.default_rng(29)
    factors = rng.integers(0, 1 << 32, (BANDS, ROWS), np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, (BANDS, ROWS), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in kernels.text_chunks(batch.column("text"), 1 << 18):
                points, starts, ends, doc, number = _lines(data, offsets)
                if not len(starts):
                    continue
                hashes, first = _hashes(points, starts, ends)
                k1, k2 = _names(points, starts, ends, hashes, first)
                at = np.unique(k1, return_index=True)[1]
                new = at[[x not in seen for x in k1[at].tolist()]]
                if len(seen) > MOST_SEEN:  # a line met again is only worked out again
                    seen.clear()
                seen.update(k1[new].tolist())
                fresh = np.zeros(len(starts), bool)
                fresh[new] = True
                own = hashes[np.repeat(fresh, np.diff(first))]
                heads = np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
                size = np.zeros(len(starts), np.int32)
                size[fresh], odd = _parities(own, heads)
                low = (own >> _U(32)).astype(np.uint32)
                values = np.empty_like(low)
                bands = np.empty((len(heads) - 1, BANDS), _U)
                for band in range(BANDS if len(low) else 0):
                    key = np.full(len(heads) - 1, band + 1, _U)
                    for r in range(ROWS):
                        np.multiply(low, factors[band, r], out=values)
                        values += shifts[band, r]
                        key = kernels.mixed(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(values, heads[:-1]))
                    bands[:, band] = key

                def lists(values: np.ndarray) -> pa.Array:
                    cuts = np.concatenate([[0], np.cumsum(np.where(fresh, values.shape[1], 0))]).astype(np.int32)
                    return pa.ListArray.from_arrays(cuts, pa.array(values.ravel().view(np.int64)))

                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][doc]), batch.column("key").take(pa.array(lo + doc)), pa.array(number), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size), lists(odd), lists(bands)], ["doc_id", "key", "line", "k1", "k2", "n", "odd", "bands"])

    return rows.select("doc_id", "key", F.col("row.text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key string, line int, k1 long, k2 long, n int, odd array<long>, bands array<long>")


def candidates(lines: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(key, node, center, last, hot) for lines that share a band key with another line, and the pairs (u, v) to try first.

    A line is named by k1 here: half its name is enough to find what may be alike, and the check of the
    texts tells apart what has the same half. A group has two centers, its first and last lines in one of
    four orders, which the key draws, and every line of the group is tried with both. A hot key's lines are
    dealt over ``SALTS`` groups, whose centers are tried with one of them.
    """
    rows = lines.select(F.explode("bands").alias("key"), F.col("k1").alias("node"))
    part = lines.filter(F.pmod("k2", F.lit(SAMPLE)) == 0).select(F.explode("bands").alias("key"))
    hot = ws.table(part.groupBy("key").count().filter(F.col("count") >= HOT).orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key"))
    order = F.col("key").bitwiseAND(3) * F.lit(((1 << 63) - 1) // 3)
    turn = F.col("node").bitwiseXOR(order)

    def shaped(rows: DataFrame, is_hot: bool) -> DataFrame:
        return rows.select("key", "node", F.col("least").bitwiseXOR(order).alias("center"), F.col("most").bitwiseXOR(order).alias("last"), F.lit(is_hot).alias("hot"))

    def met(rows: DataFrame) -> DataFrame:
        """Lines of the keys that two lines have. Most keys have one, so a hashed count finds the others and no key is sorted."""
        rows = rows.repartition("key")
        ends = rows.groupBy("key").agg(F.min(turn).alias("least"), F.max(turn).alias("most")).filter("least <> most")
        return shaped(rows.join(ends.hint("shuffle_hash"), "key"), False)

    if hot.isEmpty():
        both = met(rows)
    else:  # MOST_HOT keys at most
        group = Window.partitionBy("key", F.pmod("node", F.lit(SALTS)))
        salted = rows.join(F.broadcast(hot), "key", "left_semi").select("key", "node", F.min(turn).over(group).alias("least"), F.max(turn).over(group).alias("most"))
        both = met(rows.join(F.broadcast(hot), "key", "left_anti")).unionByName(shaped(salted, True))
    shared = ws.table(both.distinct())
    ws.drop(hot)
    centers = shared.filter("hot").select("key", "center").distinct()
    least = centers.groupBy("key").agg(F.min("center").alias("node"))
    pairs = shared.select("node", F.explode(F.array("center", "last")).alias("other")).unionByName(centers.join(least, "key").select("node", F.col("center").alias("other")))
    return shared, pairs.filter("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def may_link(a: str, b: str, similarity: float) -> Column:
    """False only if Jaccard is under ``similarity``, from the sizes and parities of two sets.

    Sets at Jaccard s or more differ in at most (1 - s) / (1 + s) of their summed sizes. They differ in as
    many elements as their sizes at least, and as the cells where their parities differ.
    """
    most = (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    unlike = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(1, PARITY_WORDS)), F.bit_count(F.col(f"{a}.odd")[0].bitwiseXOR(F.col(f"{b}.odd")[0])))
    return (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= most) & (unlike <= most)


def remaining(shared: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of one key that the centers left apart and that may link, each once.

    ``labels`` (node, label) has the classes so far, ``sets`` (node, n, odd) the parities. Groups whose
    lines are of one class are done. In the others a line meets the lines of other classes, in cells of two
    blocks of about ``BLOCK`` lines, and the join keeps a pair only if the bound allows it and under the
    smallest key that the two share.
    """
    member = shared.filter("hot OR (node <> center AND node <> last)").select("key", "node").distinct().join(labels, "node", "left")
    member = member.withColumn("label", F.coalesce("label", F.struct(F.col("node").alias("k1"), F.lit(0).cast("long").alias("k2"))))
    mixed = member.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("key", "size")
    member = member.join(mixed, "key")
    own = member.groupBy("node", "label").agg(F.collect_list(F.struct("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))).alias("groups")).join(sets, "node")
    x = F.struct("node", "label", "n", "odd", F.col("groups.key").alias("keys")).alias("x")
    rows = own.select(x, F.explode("groups").alias("g")).withColumn("block", F.pmod("x.node", "g.blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("g.blocks") - 1)).alias("other")
    rows = rows.select("x", F.col("g.key").alias("key"), "block", other).select("x", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    a, b = rows.withColumnsRenamed({"x": "a", "block": "ba"}), rows.withColumnsRenamed({"x": "b", "block": "bb"})
    apart = (F.col("a.label") < F.col("b.label")) & ((F.col("p") == F.col("q")) | (F.col("ba") != F.col("bb")))
    once = F.array_min(F.array_intersect("a.keys", "b.keys")) == F.col("key")
    return a.join(b, ["key", "p", "q"]).filter(apart & may_link("a", "b", similarity) & once).select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(k1, k2, body) of the lines that ``nodes`` (node: k1) names.

    A bitmap that grows with their number, up to ``MOST_BITS``, keeps most other lines from the shuffle; the
    join on the names settles the rest.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (FILTER_SHARE * nodes.count()).bit_length()))
    bit = F.pmod("node", F.lit(1 << bits)) + 1  # a bucket's first bit is 1 after a multiple of 32768
    rows = nodes.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
    known = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        known[4096 * (r.b - 1) : 4096 * r.b] = np.frombuffer(r.m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for _, _, data, offsets in kernels.text_chunks(batch.column("text"), 1 << 18):
                points, starts, ends, _, _ = _lines(data, offsets)
                if not len(starts):
                    continue
                k1 = kernels.run_hashes(points, starts, ends)
                keep = np.unique(k1, return_index=True)[1]
                bit = (k1[keep] & _U((1 << bits) - 1)).astype(np.int64)
                keep = keep[(known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
                starts, ends = starts[keep], ends[keep]
                if not len(starts):
                    continue
                hashes, first = _hashes(points, starts, ends)
                k1, k2 = _names(points, starts, ends, hashes, first)
                raw = points.tobytes()
                body = [raw[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(body, pa.string())], ["k1", "k2", "body"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "k1 long, k2 long, body string")
    return found.join(nodes.withColumnRenamed("node", "k1"), "k1", "left_semi").dropDuplicates(["k1", "k2"])


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of nodes, structs of k1 and k2, whose shingle sets have at least this Jaccard similarity; pairs are of k1.

    Shingles are compared by 48 bits of their hash or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.add(*(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("a", "b")))
            cut = np.flatnonzero(np.diff(np.cumsum(size) >> 21, prepend=0))  # slices of about 2 MB of text
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(size)]):
                if lo == hi:
                    continue
                sets, sizes = [], []
                for c in ("a", "b"):
                    for _, _, data, offsets in kernels.text_chunks(batch.column(c).slice(lo, hi - lo), 1 << 62, 1 << 62):
                        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
                        at = np.concatenate([[0], np.cumsum(kernels.HEAD[data])])[offsets]
                        both, low = _distinct(*_hashes(points, at[:-1], at[1:]))
                        sets.append(both)
                        sizes.append(np.bincount((both >> _U(low)).astype(np.int64), minlength=hi - lo))
                met = np.sort(np.concatenate(sets))
                met = met[:-1][met[1:] == met[:-1]] >> _U(low)
                shared = np.bincount(met.astype(np.int64), minlength=hi - lo)
                keep = shared >= similarity * (sizes[0] + sizes[1] - shared) - 1e-9
                yield batch.slice(lo, hi - lo).select(["u", "v"]).filter(pa.array(keep))

    named = texts.select("k1", F.struct("k1", "k2").alias("node"), "body")
    both = pairs.withColumnRenamed("v", "k1").join(named, "k1").select("u", F.col("node").alias("v"), F.col("body").alias("b"))
    both = both.withColumnRenamed("u", "k1").join(named, "k1").select(F.col("node").alias("u"), "v", F.col("body").alias("a"), "b")
    node = "struct<k1:bigint,k2:bigint>"
    return both.mapInArrow(run, f"u {node}, v {node}")


def merged(classes: DataFrame, links: DataFrame, ws: Workspace) -> DataFrame:
    """Classes (node, label) after more links (u, v): only the labels that links join are worked out anew."""
    ends = links
    for c in ("u", "v"):
        ends = ends.join(classes.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")), c, "left")
    ends = ends.select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v"))
    up = ws.table(connected(ends, ws)).toDF("label", "higher")
    new = links.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(classes, "node", "left_anti")
    every = classes.unionByName(new.withColumn("label", F.col("node")))
    return every.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label"))


def line_classes(rows: DataFrame, ws: Workspace, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc_id, key, line, node) of keyed rows, and (node, label) of those with a near copy of other text.

    Lines link that share a band key and are as similar as asked. Each is first held against its groups'
    centers. What stays in different classes of a group is then held against each other, unless an exact
    bound on the similarity rules it out, so no link between classes is lost.
    """
    wide = ws.table(signatures(rows))
    shared, pairs = candidates(wide, ws)
    nodes = shared.select("node").distinct()
    sets = ws.table(wide.filter("n > 0").select(F.col("k1").alias("node"), "n", "odd").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    a, b = (sets.select(F.col("node").alias(w), F.struct("n", "odd").alias(x)) for w, x in (("u", "a"), ("v", "b")))
    near = ws.table(pairs.join(a, "u").join(b, "v").filter(may_link("a", "b", similarity)).select("u", "v"))
    # The text of what passed, and of lines in groups that two centers can't settle.
    rest = shared.filter("hot OR (node <> center AND node <> last)")
    rest = rest.join(rest.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("key"), "key", "left_semi").select("node")
    wanted = ws.table(near.select(F.explode(F.array("u", "v")).alias("node")).union(rest).distinct())
    texts = ws.table(texts_of(rows.select("row.text"), wanted))
    links = ws.table(_verified(near, texts, similarity))
    classes = ws.table(connected(links, ws))
    ws.drop(near, wanted, links)
    more = ws.table(_verified(ws.table(remaining(shared, classes.select(F.col("node.k1").alias("node"), "label"), sets, similarity)), texts, similarity))
    if not more.isEmpty():
        classes = ws.table(merged(classes, more, ws))
    ws.drop(shared, sets, texts, more)
    return wide.select("doc_id", "key", "line", F.struct("k1", "k2").alias("node")), classes


def dropped_lines(rows: DataFrame, ws: Workspace, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, dropped): the numbers of the lines (from 0) that a row of ``rows`` (doc_id, key, row) loses, if any.

    Of the lines of a class, which are equal or linked by near copies, the first by doc_id, key and number
    stays. Blank lines are never dropped and belong to no class. A null text has no lines. Each row is a
    document of its own, also where rows repeat a doc_id; a null doc_id is the largest. Other columns are
    ignored.
    """
    lines, classes = line_classes(rows, ws, similarity)
    place = ["doc_id", "key", "line"]
    # Grouped by two numbers, not by their struct, which Spark sorts far slower.
    firsts = lines.groupBy(F.col("node.k1"), F.col("node.k2")).agg(F.min(F.struct(*place)).alias("at"))
    firsts = ws.table(firsts.select(F.struct("k1", "k2").alias("node"), "at"))
    labelled = ws.table(firsts.join(classes, "node").select("label", "at"))
    kept = labelled.groupBy("label").agg(F.min("at").alias("at"))
    # A line goes if it isn't the first of its text, or if that isn't the first of its class.
    again = lines.select(*place).join(firsts.select("at.*"), place, "left_anti")
    beaten = labelled.select("at.*").join(kept.select("at.*"), place, "left_anti")
    out = ws.table(again.unionByName(beaten).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("dropped")))
    ws.drop_all_but(out)
    return out


def without_lines(text: Column, dropped: Column) -> Column:
    """A text without the lines of these numbers, in time that grows with its lines."""

    def rest(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)  # by a hash set
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    return F.get(F.transform(F.array(F.split(text, "\n")), rest), F.lit(0))  # a list of one, so the text is split once


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without their dropped lines; the other columns stay, n_chars is counted anew."""
    spark = docs.sparkSession
    packed = keyed(docs, Workspace(spark, "rows"))
    gone = dropped_lines(packed, Workspace(spark, "lines"), similarity)
    rest = without_lines(F.col("row.text"), F.col("dropped"))
    row = F.col("row").withField("text", rest)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(rest).cast(docs.schema["n_chars"].dataType))
    # Keys of rows grow with the table: they are joined by a shuffle at every size, never sent to all tasks.
    out = packed.join(gone.hint("merge"), ["doc_id", "key"], "left").select(F.when(F.col("dropped").isNull(), F.col("row")).otherwise(row).alias("row"))
    return out.select("row.*")


def digest(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_dropped and the dropped lines' numbers, for every document."""
    spark = docs.sparkSession
    rows = keyed(docs, Workspace(spark, "rows"))
    gone = dropped_lines(rows, Workspace(spark, "lines"), similarity)
    return rows.select("doc_id", "key").join(gone, ["doc_id", "key"], "left").select(loose(), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
