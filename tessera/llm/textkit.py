"""Vectorised text kernels on Arrow string columns: ASCII folding, word boundaries, word hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one round of NumPy work takes; a longer text makes a round of its own.
CHUNK = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: bytes.translate() table that lower-cases A-Z only.
FOLD = _FOLD.tobytes()

#: Whitespace of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Non-word bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, which is applied after folding.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True
_NORM = _FOLD.copy()
_NORM[PUNCT[_FOLD]] = 32
#: bytes.translate() table: folds A-Z and turns every non-word byte into a blank.
NORM = _NORM.tobytes()

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x, np.uint64)]), dtype=np.uint64) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, row count, bytes, offsets) of consecutive rows with about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def texts(column: pa.Array):
    """Every text as bytes; null counts as empty."""
    for _, n, data, offsets in chunks(column):
        raw = data.tobytes()
        for i in range(n):
            yield raw[offsets[i] : offsets[i + 1]]


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (maximal run of bytes outside ``gap``; none crosses a text), and each text's first word (n + 1 entries)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    after = np.empty(len(data), bool)
    after[0] = True
    after[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    after[edges] = True
    starts = np.flatnonzero(inside & after)
    before = np.empty(len(data), bool)
    before[:-1] = ~inside[1:]
    before[-1] = True
    before[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(inside & before) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, lower-cased in A-Z; equal words have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def output(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
