"""Text expressions: tokens, folding, normal forms, sanitising."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
FOLDS = {
    "a": "àáảãạâầấẩẫậăằắẳẵặäå",
    "e": "èéẻẽẹêềếểễệë",
    "i": "ìíỉĩịîï",
    "o": "òóỏõọôồốổỗộơờớởỡợö",
    "u": "ùúủũụûüưừứửữự",
    "y": "ỳýỷỹỵÿ",
    "d": "đ",
    "c": "ç",
    "n": "ñ",
}
FOLD_FROM = "".join(FOLDS.values())
FOLD_TO = "".join(k * len(v) for k, v in FOLDS.items())
WORDS = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Words of letters, digits and underscores, lower-cased; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """Words of two characters or more, and numbers."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}|[0-9]"), F.lit(0))  # a run of two or more is always taken whole


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    lone = r"(?<![\p{L}\p{N}_])[0-9](?![\p{L}\p{N}_])"
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}|" + lone))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def normalise(text: Column) -> Column:
    """Folded and trimmed, without punctuation."""
    return F.regexp_replace(F.trim(fold(text)), r"[^\p{L}\p{N}_\s]", "")


def metric_form(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def sanitise(text: Column) -> Column:
    """Without control characters and tags of up to 200 characters; runs of blanks cut to two."""
    steps = ((r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " "), (r"<[^>]{1,200}>", " "), (r"[ ]{3,}", "  "))
    return F.trim(reduce(lambda c, s: F.regexp_replace(c, *s), steps, text))


def query_form(text: Column, most: int = 200) -> Column:
    """The head of a query without angle brackets and quotes."""
    return F.translate(F.trim(F.substring(text, 1, most)), "<>\"'", "")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Part of a's distinct elements that b has; an empty a gives 1."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(1.0))


def sentences(text: Column) -> Column:
    return F.split(F.trim(text), r"(?<=[.!?])\s+")


def windows(text: Column, width: int = 750, step: int = 630) -> Column:
    """(chunk_index, start, body) of overlapping windows, the last one partial."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s, i: F.struct(i.cast("long").alias("chunk_index"), s.cast("long").alias("start"), F.substring(text, s + 1, F.lit(width)).alias("body")))


def strip_marks(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` decomposed and without combining marks. Spark has no normal forms, so this is an Arrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            bare = [None if t is None else t if t.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(bare, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def fold_marks(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``column`` decomposed, without the marks U+0300 to U+036F, and with đ as d. Other marks stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = dict.fromkeys(range(0x300, 0x370))
        for batch in batches:
            at = batch.schema.get_field_index(column)
            bare = [None if t is None else t if t.isascii() else unicodedata.normalize("NFD", t).translate(gone).replace("đ", "d") for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(bare, batch.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)
