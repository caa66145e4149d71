"""Vectorised text kernels for Arrow batches.

Every kernel works on the UTF-8 bytes of a whole slice of documents at once. Slices hold about
``CHUNK_BYTES`` bytes (one document at least, whole documents only), so memory stays bounded however
large an Arrow batch is. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}

#: Bytes of words under the contract classes. A byte of a multi-byte character is >= 0x80.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Not a continuation byte: one for each code point.
HEAD = (np.arange(256) & 0xC0) != 0x80


def text_chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 15) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of slices of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + max_bytes, "right")) - 1), lo + max_rows)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, and each document's first run (one more at the end)."""
    return runs_of(is_word[data], offsets)


def runs_of(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for places that are marked already."""
    n = len(inside)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    before[cut] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES + 1), pow(_MULT, -1, 1 << 64) if kind == "inverse" else _MULT, _U)
        step[0] = 1
        have = _powers[kind] = np.cumprod(step, dtype=_U)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(32)
    h *= _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes, the same wherever the run stands."""
    n = len(data)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("plain", n), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power("inverse", n + 1)[starts] + (ends - starts).astype(_U))


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, 0 for an empty range."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
