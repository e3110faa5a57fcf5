"""Vectorised word hashing over Arrow text columns, and streaming helpers for Arrow operators.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Its hash is a polynomial over
random 64-bit byte codes modulo 2**64, found for all words of a buffer from one running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_CODES = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64, 256, dtype=_U)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_STEP_INVERSE = pow(_STEP, -1, 2**64)
#: Bytes hashed with one running sum.
SEGMENT = 1 << 17
#: Bytes of text taken up together; a longer document is taken alone.
CHUNK = 1 << 20
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT)
        tables = []
        for base in (_STEP, _STEP_INVERSE):
            factors = np.full(size, base, dtype=_U)
            factors[0] = 1
            tables.append(np.multiply.accumulate(factors))
        _powers[:] = tables
    return _powers


def scramble(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit hashes."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``lo`` to ``hi`` with their UTF-8 bytes and byte offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each document's words begin in them."""
    word = ~_SPACE[data]
    cuts = offsets[:-1][np.diff(offsets) > 0]
    opened = word.copy()
    opened[1:] &= ~word[:-1]
    opened[cuts] = word[cuts]
    closed = word.copy()
    closed[:-1] &= ~word[1:]
    last = cuts[1:] - 1
    closed[last] = word[last]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SEGMENT, side="right")))
        b = ends[j - 1]
        power, inverse = _power_tables(int(b - a))
        sums = np.empty(b - a + 1, dtype=_U)
        sums[0] = 0
        np.cumsum(_CODES[data[a:b]] * power[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return scramble(out + (ends - starts).astype(_U))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (of the whole buffer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return scramble(out)


def run_starts(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the buffer at which ``k`` words of one document begin, and that document's row."""
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(rows)) - np.repeat(firsts - word_offsets[:-1], counts), rows


def ragged(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive slices of ``flat``."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def pack_longs(values: np.ndarray) -> bytes:
    """64-bit integers with their highest bytes first of all, then the next ones: equal bytes meet and compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T[::-1]).tobytes()


def unpack_longs(packed: pa.Buffer) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes[::-1].T).view(np.int64).ravel()


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str], most_rows: int, most_bytes: int) -> Iterator[pa.Table]:
    """Tables of whole groups from input sorted by ``key``: many small ones together, up to the limits."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        at = 0
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for name in key:
            column = batch.column(name)
            if batch.num_rows > 1:
                change[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        if held and any(held[-1].column(name)[-1] != batch.column(name)[0] for name in key):
            change[0] = True
        per_row = batch.nbytes / batch.num_rows
        for cut in np.flatnonzero(change):
            if rows + (cut - at) >= most_rows or size + (cut - at) * per_row >= most_bytes:
                if cut > at:
                    held.append(batch.slice(at, cut - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, rows, size, at = [], 0, 0, int(cut)
        if batch.num_rows > at:
            held.append(batch.slice(at))
            rows += batch.num_rows - at
            size += (batch.num_rows - at) * per_row
    if held:
        yield pa.Table.from_batches(held)
