"""Vector code compression: product codes from integer codebooks (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import blocks, common_length, exact_range, integers, matrix, usable
from .workspace import Workspace

#: Rows whose distances to a codebook are held at once: 4096 x 256 integers are 8 MB.
ROWS = 4096


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the first among equals, and the squared distance, all in int64.

    |x - e|^2 = |x|^2 - 2 x.e + |e|^2, and |x|^2 says nothing about which entry is nearest.
    """
    to = (book * book).sum(axis=1) - 2 * (part @ book.T)
    at = to.argmin(axis=1)
    return at, to[np.arange(len(at)), at] + (part * part).sum(axis=1)


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """(part, row, position) of a block's integer vectors."""
    vecs = matrix(batch.column("vec"), np.int64)
    return vecs.reshape(len(vecs), parts, -1).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, n, sums): how many parts an entry is nearest to, and their componentwise sums.

    A task sums its own rows, so at most one row for each entry and task is shuffled.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in blocks(batches, ROWS):
            for p, x in enumerate(_parts(batch, parts)):
                at, _ = nearest(x, known[p])
                n[p] += np.bincount(at, minlength=entries)
                np.add.at(sums[p], at, x)
        p, e = np.nonzero(n)
        offsets = pa.array((np.arange(len(p) + 1) * width).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.ListArray.from_arrays(offsets, pa.array(sums[p, e].ravel()))], ["part", "entry", "n", "sums"])

    each = rows.select("vec").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.get("sums", F.lit(i))) for i in range(width)]
    return each.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*total).alias("sums"))


def prepare(vectors: DataFrame, vec_id: str, vector: str, label: str | None, scale: int) -> tuple[DataFrame, int]:
    """(vec_id, label, vec) of the rows that take part, and the length of their vectors."""
    named = F.col(label) if label else F.lit(None).cast("int")
    kept = vectors.select(F.col(vec_id).alias("vec_id"), named.alias("label"), F.col(vector).alias("raw")).filter(usable("raw"))
    length = common_length(kept, "raw")
    # Differences are at most twice a component, so their squares' sum stays below 2^62.
    rows = kept.filter(F.size("raw") == length).select("vec_id", "label", integers("raw", scale, exact_range(length, 60)).alias("vec"))
    return rows, length


def fit(rows: DataFrame, length: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks (part, entry, position) of prepared rows (vec_id, vec) after ``rounds`` rounds of Lloyd's method in integers.

    They start as the parts of the rows with the smallest vec_ids (null last, then by vector). A round sends
    the codebooks to every task, and gets a row for each entry back; an entry without parts stays. Only
    codebooks, whose size is fixed, come to the driver.
    """
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").collect()
    books = np.array([r.vec for r in first], np.int64).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) else 0):
        for r in _sums(rows, books).collect():
            books[r.part, r.entry] = np.array(r.sums, np.int64) // r.n
    return books


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of prepared rows: an entry index of two hex digits or more for each part."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        hexes = np.array([f"{i:02x}" for i in range(known.shape[1])], object)
        for batch in blocks(batches, ROWS):
            codes, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for p, x in enumerate(_parts(batch, parts)):
                at, d = nearest(x, known[p])
                codes += hexes[at]
                error += d
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vec").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """``codes`` with ``approx``, the integer vector that a code stands for."""
    one = F.array(*(F.array(*(F.array(*map(F.lit, e)) for e in book)) for book in books.tolist()))
    parts = [F.get(F.get(one, F.lit(p)), F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p in range(books.shape[0])]
    return codes.withColumn("approx", F.concat(*parts))


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each vector that takes part.

    Null vectors and those with a null or non-finite component are left out, and so are vectors of another
    length than the most common one, which no codebook of that length fits. Components become integers,
    held within the range in which all sums of squares are exact (beyond 2^28 for 64 components). A null
    vec_id is an id, the last in order; repeated rows each count; null labels are one label. With fewer
    rows than entries the codebooks are that much smaller. Other columns are ignored. An empty table gives
    an empty result.
    """
    ws = Workspace(vectors.sparkSession, "codes")
    rows, length = prepare(vectors, vec_id, vector, label, scale)
    rows = ws.table(rows)
    books = fit(rows, length, parts, entries, rounds)
    if not books.size:
        kind = dict(rows.dtypes)["vec_id"]
        return rows.limit(0).select(F.col("vec_id").cast(kind), *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    coded = ws.table(encode(rows, books))
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _compress_sql(rounds: int = 4) -> str:
    nearest_to = """(SELECT r, part, x, q.e, q.d + list_dot_product(x, x) AS d FROM (
      SELECT p.r, p.part, any_value(p.x) AS x, min({{'d': list_dot_product(b.x, b.x) - 2 * list_dot_product(p.x, b.x), 'e': b.e}}) AS q
      FROM p JOIN b{0} b USING (part) GROUP BY p.r, p.part))"""
    out = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v
  FROM (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
p AS MATERIALIZED (SELECT r, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM k, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, x FROM p WHERE r <= 256)"""
    for i in range(rounds):
        out += f""",
a{i} AS MATERIALIZED {nearest_to.format(i)},
m{i} AS MATERIALIZED (
  SELECT part, e, list(m ORDER BY pos) AS x FROM (
    SELECT part, e, pos, floor(sum(c) / count(*)) AS m FROM (SELECT part, e, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY ALL)
  GROUP BY part, e),
b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m{i}.x, b{i}.x) AS x FROM b{i} LEFT JOIN m{i} USING (part, e))"""
    return (
        out
        + f""",
f AS MATERIALIZED {nearest_to.format(rounds)},
c AS (SELECT r, string_agg(format('{{:02x}}', e::BIGINT), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
s AS (SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, e, pos)) AS sha FROM (SELECT part, e, unnest(x) AS c, generate_subscripts(x, 1) AS pos FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM k JOIN c USING (r), s
"""
    )


COMPRESS_SQL = _compress_sql()
