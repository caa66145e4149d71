"""Chunks of tables in texts: whole rows under a repeated header."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and how many times that a table may have and stay whole; lines with a bar that make a table, at least so many and so large a part.
SIZE, WHOLE, LEAST_LINES, LEAST_SHARE = 750, 3, 2, 0.35


def is_table(text: Column) -> Column:
    """Whether two or more of a text's lines, and 35 in 100 of those that aren't blank, have a bar."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != "")
    barred = F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|"))))
    return (barred >= LEAST_LINES) & (barred >= LEAST_SHARE * F.size(lines))


def pack_rows(rows: list[str], size: int = SIZE) -> list[str]:
    """Chunks of whole rows, up to ``size`` characters; each after the first begins with the first row.

    A row that is longer than that stands with the header alone. Up to ``WHOLE`` times the size the rows
    stay in one chunk.
    """
    if len("\n".join(rows)) <= WHOLE * size:
        return ["\n".join(rows)] if rows else []
    out, now, length = [], [], 0
    for row in rows:
        if now and length + len(row) + 1 > size:
            out.append(now)
            now = [rows[0]] if row != rows[0] else []
            length = sum(len(x) + 1 for x in now)
        now = [*now, row]
        length += len(row) + 1
    return ["\n".join(x) for x in [*out, now]]


def table_chunks(docs: DataFrame, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """(key, chunk_index, body) of the texts (key, text) that are tables; a row's blanks are single, blank lines go.

    Which texts are tables is found before any row goes to Python. A text is packed in one piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                rows = [re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
                out += [(k, i, c) for i, c in enumerate(pack_rows([x for x in rows if x], size))]
            keys, index, body = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(key).type), pa.array(index, pa.int64()), pa.array(body, pa.string())], [key, "chunk_index", "body"])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, "text").filter(is_table(F.col("text"))).mapInArrow(run, f"{key} {kind}, chunk_index long, body string")
