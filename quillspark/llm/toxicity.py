"""Toxicity: a convolutional text classifier trained in numpy (operator 5)."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .folds import held_out, id_bits, id_filter, labels_to_learn
from .workspace import Workspace

#: A word has an embedding by its hash and one by the hash of its first bytes, which unseen forms share.
WORD_BITS, STEM_BITS, STEM_BYTES = 17, 15, 4
STEMS = 1 << WORD_BITS
PADDING = STEMS + (1 << STEM_BITS)
EMBEDDING = 16
FILTER_WIDTHS, FILTERS = (1, 2, 3), 16
PAD = 3  # rows end in so many padding words, so no window reaches the next row
#: Rows and words that one task trains on, about; passes over all rows take this many steps' worth of rows, from two to five.
SHARD_ROWS, SHARD_WORDS, PASS_ROWS = 12_000, 16_000_000, 60_000
#: Fractions in which trained values are summed, so that sums hang on no order; cells of the logit in which thresholds are sought.
UNIT, CELLS, LOGIT = 1 << 28, 1 << 16, 30.0
#: Scores from here on are predicted toxic.
CUT = 0.3


def word_buckets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, hashed words and stems, first word of each row) with padding words in place."""
    for lo, hi, data, offsets in kernels.text_chunks(column):
        data = kernels.LOWER[data]
        starts, ends, first = kernels.runs(data, offsets, kernels.ALNUM)
        words = kernels.run_hashes(data, starts, ends) >> np.uint64(64 - WORD_BITS)
        stems = kernels.run_hashes(data, starts, np.minimum(ends, starts + STEM_BYTES)) >> np.uint64(64 - STEM_BITS)
        yield lo, hi, *padded(np.stack([words.astype(np.int32), stems.astype(np.int32) + STEMS], axis=1), first)


def padded(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    out = np.full((len(words) + PAD * len(n), 2), PADDING, np.int32)
    out[np.arange(len(words)) + PAD * np.repeat(np.arange(len(n)), n)] = words
    return out, first + PAD * np.arange(len(n) + 1)


def _segments(first: np.ndarray) -> np.ndarray:
    """Bounds for reduceat: a row's words and one padding word, then the rest of the padding, which is left out."""
    return np.stack([first[:-1], first[1:] - PAD + 1], axis=1).ravel()


class ConvNet:
    """Hashed word embeddings, filters of several widths, max pooling over the whole text, a logistic output."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        d, f = EMBEDDING, FILTERS
        self.emb = rng.normal(0, 0.05, (PADDING + 1, d)).astype(np.float32)
        self.emb[PADDING] = 0
        self.conv = [rng.normal(0, (1 / (w * d)) ** 0.5, (w, d, f)).astype(np.float32) for w in FILTER_WIDTHS]
        self.bias = np.zeros((len(FILTER_WIDTHS), f), np.float32)
        self.out = rng.normal(0, 0.1, len(FILTER_WIDTHS) * f).astype(np.float32)
        self.shift = np.float32(0)
        self.constant: float | None = None
        self.offset = 0.0

    def _maxima(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each width the filters' values at every place, and their maxima by row."""
        tokens = self.emb[words[:, 0]]
        tokens += self.emb[words[:, 1]]
        for w, conv in zip(FILTER_WIDTHS, self.conv):
            sums = tokens @ conv[0]
            for j in range(1, w):
                sums[:-j] += tokens[j:] @ conv[j]
            yield sums, np.maximum.reduceat(sums, _segments(first), axis=0)[::2]

    def scores(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        pooled = np.concatenate([top + self.bias[k] for k, (_, top) in enumerate(self._maxima(words, first))], axis=1)
        z = (np.maximum(pooled, 0) @ self.out + self.shift).astype(np.float64) + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def start(self, present: np.ndarray, n: np.ndarray) -> None:
        """Embeddings start from the log-odds of words and stems in toxic and other texts: of n texts of each kind so many hold each."""
        odds = np.log((present[1] + 0.5) / (n[1] + 1)) - np.log((present[0] + 0.5) / (n[0] + 1))
        # A word that few texts hold says little.
        self.emb[:, 0] = np.clip(odds, -3, 3) * np.minimum(1, present.sum(axis=0) / 5) / 2
        self.emb[PADDING] = 0
        half = FILTERS // 2
        self.conv[0][0, 0, :half] = np.abs(self.conv[0][0, 0, :half]) + 0.5
        self.out[:half] = np.abs(self.out[:half])

    def packed(self) -> np.ndarray:
        """All trained values as rows of ``EMBEDDING``: the embeddings, then the rest one after the other."""
        rest = np.concatenate([*(c.ravel() for c in self.conv), self.bias.ravel(), self.out, [self.shift]])
        return np.concatenate([self.emb, np.pad(rest, (0, -len(rest) % EMBEDDING)).reshape(-1, EMBEDDING)]).astype(np.float64)

    def unpack(self, rows: np.ndarray) -> None:
        self.emb = rows[: PADDING + 1].astype(np.float32)
        rest = rows[PADDING + 1 :].ravel().astype(np.float32)
        *conv, bias, out = (x.reshape(shape) for x, shape in zip(np.split(rest, np.cumsum([x.size for x in (*self.conv, self.bias, self.out)])), [x.shape for x in (*self.conv, self.bias, self.out)]))
        self.shift = rest[sum(x.size for x in (*self.conv, self.bias, self.out))]
        self.conv, self.bias, self.out = conv, bias, out

    def train(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 5e-3, seed: int = 11) -> None:
        """Adam on the log loss."""
        rng = np.random.default_rng(seed)
        moment = {x: [0.0, 0.0] for x in ("out", "shift", "bias", *(f"conv{k}" for k in range(len(self.conv))))}
        moment["emb"] = [np.zeros_like(self.emb), np.zeros_like(self.emb)]
        step = 0
        for _ in range(epochs):
            for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                step += 1
                cuts = np.concatenate([[0], np.cumsum([len(rows[i]) for i in pick])])
                words, first = padded(np.concatenate([rows[i] for i in pick]), cuts)
                for x, g in self._gradients(words, first, y[pick]).items():
                    self._adam(x, g, moment[x], step, rate)
                self.emb[PADDING] = 0

    def _gradients(self, words: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        pooled, places = [], []
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        inside = np.arange(len(words)) < (first[1:] - PAD + 1)[row]
        for k, (sums, top) in enumerate(self._maxima(words, first)):
            at, f = np.nonzero((sums == top[row]) & inside[:, None])
            place = np.zeros(top.shape, np.int64)
            place[row[at][::-1], f[::-1]] = at[::-1]  # the first of equal places
            pooled.append(top + self.bias[k])
            places.append(place)
        h = np.concatenate(pooled, axis=1)
        act = np.maximum(h, 0)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.shift, -30, 30)))
        dz = ((p - y) / len(y)).astype(np.float32)
        dh = np.outer(dz, self.out) * (h > 0)
        split = np.split(dh, len(FILTER_WIDTHS), axis=1)
        grads = {"out": act.T @ dz, "shift": dz.sum(), "bias": np.stack([d.sum(axis=0) for d in split])}
        at_words, d_tokens = [], []
        for k, (w, d) in enumerate(zip(FILTER_WIDTHS, split)):
            f = np.broadcast_to(np.arange(FILTERS), d.shape).ravel()
            place, d = places[k].ravel(), d.ravel()
            live = np.flatnonzero(d)
            f, place, d = f[live], place[live], d[live, None]
            dconv = np.zeros_like(self.conv[k])
            for j in range(w):
                ids = words[place + j]
                part = np.zeros((FILTERS, EMBEDDING), np.float32)
                np.add.at(part, f, d * (self.emb[ids[:, 0]] + self.emb[ids[:, 1]]))
                dconv[j] = part.T
                at_words.append(ids)
                d_tokens.append(d * self.conv[k][j].T[f])
            grads[f"conv{k}"] = dconv
        ids, d_tokens = np.concatenate(at_words), np.concatenate(d_tokens)
        used, local = np.unique(ids.ravel(), return_inverse=True)
        demb = np.zeros((len(used), EMBEDDING), np.float32)
        np.add.at(demb, local.ravel(), np.repeat(d_tokens, 2, axis=0))
        grads["emb"] = (used, demb)
        return grads

    def _adam(self, name: str, g, moment: list, step: int, rate: float) -> None:
        if name == "emb":  # rows that the batch doesn't hold are left alone
            used, g = g
            m, v = moment[0][used], moment[1][used]
        else:
            m, v = moment
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        delta = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if name == "emb":
            moment[0][used], moment[1][used] = m, v
            self.emb[used] -= delta.astype(np.float32)
            return
        moment[:] = [m, v]
        if name.startswith("conv"):
            self.conv[int(name[4:])] -= delta.astype(np.float32)
        else:
            setattr(self, name, (getattr(self, name) - delta).astype(np.float32))


def best_cut(scores: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold of best F1 of scores that n rows have, so many of them toxic; midway to the next lower score."""
    order = np.argsort(-scores, kind="stable")
    s, n, t = scores[order], n[order], toxic[order]
    k = int((2 * np.cumsum(t) / (np.cumsum(n) + t.sum())).argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def _lists(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems of all rows of a table, and each row's first."""
    words, stems = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table.column("words"), table.column("stems")))
    cuts = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return np.stack([words.flatten().to_numpy(), stems.flatten().to_numpy()], axis=1), cuts


def _encode(bits) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words and stems of the rows that the filter of ids holds."""
        for batch in batches:
            first, second = (batch.column(c).to_numpy() for c in ("first", "second"))
            batch = batch.filter(pa.array((bits.value[first >> 6] >> (first & 63) & bits.value[second >> 6] >> (second & 63) & 1) > 0))
            for lo, hi, words, first in word_buckets(batch.column("text")):
                words = words[words[:, 0] < PADDING]
                cuts = (first - PAD * np.arange(hi - lo + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(words[:, i]))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "h", "lang", "hold")), *lists], ["doc_id", "h", "lang", "hold", "words", "stems"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's texts of each kind that hold a word or stem; under ``PADDING`` all of them."""
    size = PADDING + 1
    present = np.zeros(2 * size, np.int64)
    for batch in batches:
        flat, cuts = _lists(batch)
        row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
        y = batch.column("y").to_numpy().astype(np.int64)
        for part in (0, 1):
            pairs = np.unique(row * size + flat[:, part])
            present += np.bincount(y[pairs // size] * size + pairs % size, minlength=2 * size)
        present += np.bincount(y * size + PADDING, minlength=2 * size)
    at = np.flatnonzero(present)
    yield pa.RecordBatch.from_arrays([pa.array(at // size), pa.array(at % size), pa.array(present[at])], ["y", "at", "n"])


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, h, y, lang, hold, words, stems) of all labelled training rows.

    A filter of the labelled ids leaves out other rows before anything is shuffled, and a row goes to its label
    as hashed words. The join is by a shuffle at every size.
    """
    pick = labels_to_learn(labels, "toxic")
    bits = id_filter(pick)
    first, second = id_bits(64 * len(bits))
    hold = F.pmod(F.xxhash64(F.lit("hold"), "doc_id"), F.lit(5)) == 4
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    rows = rows.select("doc_id", first.alias("first"), second.alias("second"), F.xxhash64("text", "lang").alias("h"), "lang", hold.alias("hold"), "text")
    words = rows.mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(bits)), "doc_id long, h long, lang string, hold boolean, words array<int>, stems array<int>")
    return words.join(pick.hint("merge"), "doc_id").select("doc_id", "h", "y", "lang", "hold", "words", "stems")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[ConvNet, dict[str, float]]:
    """The network and a threshold for each language, from all labelled training rows.

    A fifth of the rows is kept from training. All others are counted for the start of the embeddings; then
    shards of them, each of bounded size, are trained on by a task each from that start, in two to five
    passes. What a shard changes is averaged: an embedding by the texts that hold it, the rest by texts. On
    the rows that were kept the output is shifted so that the best common threshold is ``CUT``, and each
    language with enough rows of both kinds gets a threshold of its own.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "toxicity")
    rows = space.table(learning_rows(docs, labels))
    try:
        return _fitted(rows)
    finally:
        space.drop(rows)


def _fitted(rows: DataFrame) -> tuple[ConvNet, dict[str, float]]:
    net = ConvNet()
    spark, learned = rows.sparkSession, rows.filter(~F.col("hold"))
    held = learned.mapInArrow(_holders, "y long, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()  # of fixed size
    present = np.zeros((2, PADDING + 1))
    np.add.at(present, (held.column("y").to_numpy(), held.column("at").to_numpy()), held.column("n").to_numpy())
    n = present[:, PADDING].copy()
    present[:, PADDING] = 0
    if not n.all():
        net.constant = float(n[1] > 0)
        return net, {}
    net.start(present, n)
    n_words = learned.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, int(-(-n.sum() // SHARD_ROWS)), -(-n_words // SHARD_WORDS))
    epochs = int(np.clip(-(-PASS_ROWS // n.sum()), 2, 5))
    begin = net.packed()
    start = spark.sparkContext.broadcast(net)

    def train(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [(c, "ascending") for c in ("doc_id", "h", "y")]).to_numpy()  # the same order each run
        flat, cuts = _lists(table)
        rows = [flat[cuts[i] : cuts[i + 1]] for i in order]
        own = copy.deepcopy(start.value)
        before = own.packed()
        own.train(rows, table.column("y").to_numpy().astype(np.int64)[order], epochs)
        weight = np.full(len(before), len(table))
        weight[: PADDING + 1] = 0
        for row in rows:  # one by one: a shard's pairs of rows and words at once would be several times its words
            for i in (0, 1):
                weight[np.unique(row[:, i])] += 1
        at = np.flatnonzero(weight)
        moved = np.rint((own.packed()[at] - before[at]) * UNIT).astype(np.int64) * weight[at, None]
        lists = pa.ListArray.from_arrays(np.arange(0, EMBEDDING * len(at) + 1, EMBEDDING, dtype=np.int32), pa.array(moved.ravel()))
        return pa.table([pa.array(at), pa.array(weight[at]), lists], ["at", "weight", "moved"])

    parts = learned.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).groupBy("shard").applyInArrow(train, "at long, weight long, moved array<long>")
    mean = parts.groupBy("at").agg(F.sum("weight").alias("weight"), F.array(*(F.sum(F.get("moved", F.lit(i))) for i in range(EMBEDDING))).alias("moved")).toArrow()
    at = mean.column("at").to_numpy()
    begin[at] += mean.column("moved").combine_chunks().flatten().to_numpy().reshape(-1, EMBEDDING) / mean.column("weight").to_numpy()[:, None] / UNIT
    net.unpack(begin)
    shared = spark.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, cuts = _lists(batch)
            p = shared.value.scores(*padded(flat, cuts))
            z = np.log(p) - np.log1p(-p)
            cell = np.minimum((z + LOGIT) / (2 * LOGIT) * CELLS, CELLS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(cell), batch.column("lang")], ["y", "cell", "lang"])

    cells = rows.filter("hold").mapInArrow(logits, "y int, cell long, lang string").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "cell").agg(F.count("*").alias("n"), F.sum("y").alias("toxic"))
    got = cells.toArrow()  # at most CELLS rows a language
    z, n, toxic = (got.column("cell").to_numpy() + 0.5) * 2 * LOGIT / CELLS - LOGIT, got.column("n").to_numpy(), got.column("toxic").to_numpy()
    if not 0 < toxic.sum() < n.sum():
        return net, {}
    merged, place = np.unique(z, return_inverse=True)
    cut = best_cut(merged, np.bincount(place, n), np.bincount(place, toxic))
    net.offset = float(np.log(CUT / (1 - CUT)) - cut)
    lang = np.array(got.column("lang").to_pylist(), dtype=object)
    of = {x: lang == x for x in sorted(set(lang))}
    chance = lambda x: float(1 / (1 + np.exp(-np.clip(x + net.offset, -30, 30))))
    return net, {x: chance(best_cut(z[m], n[m], toxic[m])) for x, m in of.items() if min(toxic[m].sum(), (n[m] - toxic[m]).sum()) >= 20}


def score(docs: DataFrame, net: ConvNet, cuts: dict[str, float]) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and flagged (by the threshold of the row's language).

    Null and empty texts are scored as texts without words. Repeated rows each give a row. The score reads
    the text alone; the language only picks the threshold of ``flagged`` (0.3 where it has none).
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, words, first in word_buckets(batch.column("text")):
                out[lo:hi] = net.scores(words, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("lang"), pa.array(out)], ["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), lang.alias("lang"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, lang string, score double")
    cut = F.lit(CUT)
    for x, c in cuts.items():
        cut = F.when(F.coalesce("lang", F.lit("")) == x, F.lit(c)).otherwise(cut)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT).cast("int").alias("predicted"), (F.col("score") >= cut).alias("flagged"))
