"""MurmurHash3 over byte strings, vectorised by length: the 32-bit x86 form and the 128-bit x64 form."""

from __future__ import annotations

import numpy as np

# Constants of MurmurHash3.
_C1_32, _C2_32 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)

#: Seed of the HyperLogLog items, and of Bloom and cuckoo items.
HLL_SEED, FILTER_SEED = 0xADC83B19, 0x9747B28C


def _rotl(x, r, bits):
    t = x.dtype.type
    return (x << t(r)) | (x >> t(bits - r))


def _by_length(items):
    """(rows, byte matrix) of the items of each length."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer(b"".join(items[i] for i in rows), np.uint8).reshape(len(rows), int(size))


def _words(block, dtype):
    return np.ascontiguousarray(block).view(np.dtype(dtype).newbyteorder("<")).astype(dtype)


def murmur3_32(items, seed: int) -> np.ndarray:
    """uint32 hash of every item (bytes)."""
    out = np.empty(len(items), np.uint32)
    for rows, data in _by_length(items):
        n = data.shape[1]
        h = np.full(len(rows), seed, np.uint32)
        body = n // 4 * 4
        for k in _words(data[:, :body], np.uint32).T if body else ():
            h = _rotl(h ^ (_rotl(k * _C1_32, 15, 32) * _C2_32), 13, 32) * np.uint32(5) + np.uint32(0xE6546B64)
        if n > body:
            tail = np.zeros((len(rows), 4), np.uint8)
            tail[:, : n - body] = data[:, body:]
            h = h ^ (_rotl(_words(tail, np.uint32)[:, 0] * _C1_32, 15, 32) * _C2_32)
        h = h ^ np.uint32(n)
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
        out[rows] = h ^ (h >> np.uint32(16))
    return out


def _finish(h):
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def murmur3_128(items, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Both uint64 halves of the hash of every item (bytes)."""
    first, second = np.empty(len(items), np.uint64), np.empty(len(items), np.uint64)
    for rows, data in _by_length(items):
        n = data.shape[1]
        a, b = np.full(len(rows), seed, np.uint64), np.full(len(rows), seed, np.uint64)
        body = n // 16 * 16
        lanes = _words(data[:, :body], np.uint64).T if body else ()
        for i in range(0, len(lanes), 2):
            a = a ^ (_rotl(lanes[i] * _C1, 31, 64) * _C2)
            a = (_rotl(a, 27, 64) + b) * np.uint64(5) + np.uint64(0x52DCE729)
            b = b ^ (_rotl(lanes[i + 1] * _C2, 33, 64) * _C1)
            b = (_rotl(b, 31, 64) + a) * np.uint64(5) + np.uint64(0x38495AB5)
        if n > body:
            tail = np.zeros((len(rows), 16), np.uint8)
            tail[:, : n - body] = data[:, body:]
            low, high = _words(tail, np.uint64).T
            if n - body > 8:
                b = b ^ (_rotl(high * _C2, 33, 64) * _C1)
            a = a ^ (_rotl(low * _C1, 31, 64) * _C2)
        a, b = a ^ np.uint64(n), b ^ np.uint64(n)
        a = a + b
        b = b + a
        a, b = _finish(a), _finish(b)
        a = a + b
        first[rows], second[rows] = a, b + a
    return first, second


def as_bytes(values) -> list[bytes]:
    """Strings, bytes and nulls as byte strings."""
    return [v if isinstance(v, bytes) else b"" if v is None else str(v).encode() for v in values]
