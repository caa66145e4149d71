"""Chunk packing: sequential by nature, so each document is packed on its own in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGET, LARGEST, SMALLEST, DROPPED, OVERLAP = 600, 850, 300, 60, 2
_ENDS = re.compile(r"(?<=[.!?])\s+")


def hard_split(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` characters, each cut at the last blank past its middle or right at its end, else at its middle."""
    out, middle = [], most // 2
    while len(text) > most:
        cut = max(text.rfind(" ", middle + 1, most + 1), text.rfind("\n", middle + 1, most + 1), middle)
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [x for x in [*out, text.strip()] if x]


def pack(text: str, header: str = "", overlap: int = OVERLAP) -> list[str]:
    """Chunks of whole sentences near the target size; each begins with the last sentences of the one before."""
    room = len(header) + 1 if header else 0
    target, largest = max(200, TARGET - room), max(300, LARGEST - room)
    groups: list[list[str]] = []
    now: list[str] = []
    size = 0
    for sentence in (p for s in _ENDS.split(text.strip()) if s for p in hard_split(s, largest)):
        if now and size + len(sentence) + 1 > target:
            groups.append(now)
            now = now[-overlap:] if overlap else []
            size = sum(len(x) + 1 for x in now)
        now = [*now, sentence]
        size += len(sentence) + 1
    if now:
        groups.append(now)
    merged: list[list[str]] = []
    for g in groups:
        if merged and sum(len(x) + 1 for x in g) < SMALLEST:
            merged[-1] = merged[-1] + [x for x in g if x not in merged[-1][-2:]]
        else:
            merged.append(g)
    bodies = (" ".join(g) for g in merged)
    parts = (p for b in bodies if len(b) + room >= DROPPED for p in (hard_split(b, largest) if len(b) + room > LARGEST else [b]))
    return [f"{header}\n{p}" if header else p for p in parts]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk_index, body) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, i, c) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, c in enumerate(pack(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["doc_id", "chunk_index", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, chunk_index long, body string")


def by_headings(text: str, longest: int = 60) -> list[tuple[int, str]]:
    """(article, chunk) of a text: with two or more headings, lines of 1 to ``longest`` characters, an article from each to the next.

    Articles under DROPPED characters go, those up to TARGET stay whole, longer ones are packed under their
    heading; what stands before the first heading is no article. Other texts are packed whole as article 0.
    """
    starts, at = [], 0
    for line in text.split("\n"):
        if 1 <= len(line.strip()) <= longest:
            starts.append((at, line.strip()))
        at += len(line) + 1
    if len(starts) < 2:
        return [(0, c) for c in pack(text)]
    out = []
    for n, (start, heading) in enumerate(starts):
        body = text[start : starts[n + 1][0] if n + 1 < len(starts) else len(text)].strip()
        if len(body) >= DROPPED:
            out += [(n + 1, c) for c in ([body] if len(body) <= TARGET else pack(body, heading))]
    return out


def split_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, article, chunk_index, body) of every document, by its headings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, n, i, c) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for i, (n, c) in enumerate(by_headings(t or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "article", "chunk_index", "body"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, article long, chunk_index long, body string")


def compress(sentences: list[str], words: set[str], budget: int) -> str:
    """The sentences that share most words with the query, in their order, up to a budget of characters."""
    budget = max(200, budget)
    if len(". ".join(sentences)) <= budget:
        return ". ".join(sentences)
    kept = [s for s in sentences if len(s) > 10]
    score = {}
    for i, s in enumerate(kept):
        own = set(re.findall(r"\w+", s.lower()))
        score[i] = (len(own & words) / len(own) ** 0.5 if own else 0.0) + 0.05 * (i == 0)
    used, chosen = 0, []
    for i in sorted(score, key=lambda i: (-score[i], i)):
        if used + len(kept[i]) + 2 > budget:
            if used >= 0.6 * budget:
                break
            continue
        used += len(kept[i]) + 2
        chosen.append(i)
    return ". ".join(kept[i] for i in sorted(chosen)) or ". ".join(sentences)[:budget]


def compress_texts(rows: DataFrame, *keys: str, budget: int = 400) -> DataFrame:
    """(keys, body): texts of rows (keys, text, words) cut to the budget, keeping sentences near the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = [compress([x.rstrip(".!?") for x in _ENDS.split((t or "").strip())], set(w or ()), budget) for t, w in zip(batch.column("text").to_pylist(), batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(body, pa.string())], [*keys, "body"])

    return rows.select(*(F.col(k).cast("long").alias(k) for k in keys), "text", "words").mapInArrow(run, ", ".join([*(f"{k} long" for k in keys), "body string"]))
