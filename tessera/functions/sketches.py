"""Sketch kernels on NumPy arrays: HyperLogLog, Count-Min, Morris counters, Bloom chains and cuckoo filters.

Every kernel is exact to the bit: hash, seed, layout, estimator and the private random state. ``pack`` and ``unpack``
are the little-endian images of the DUMP format.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from tessera.functions.hashing import FILTER_SEED, HLL_SEED, murmur3_32, murmur3_128

MAX_BYTES = 256 << 20
U32 = 0xFFFFFFFF
_RNG_SEED = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _xorshift(x: int) -> int:
    x ^= x << 13 & _MASK
    x ^= x >> 7
    return x ^ (x << 17 & _MASK)


# ---- HyperLogLog: 2^14 registers of 6 bits


class Hll:
    P, REGISTERS, Q = 14, 1 << 14, 50

    def __init__(self, registers: np.ndarray | None = None):
        self.registers = np.zeros(self.REGISTERS, np.uint8) if registers is None else registers

    @staticmethod
    def places(items) -> tuple[np.ndarray, np.ndarray]:
        """Register and rank of every item."""
        h = murmur3_128(items, HLL_SEED)[0]
        rest = (h >> np.uint64(Hll.P)) | np.uint64(1 << Hll.Q)
        low = rest & (~rest + np.uint64(1))
        return (h & np.uint64(Hll.REGISTERS - 1)).astype(np.int32), np.log2(low.astype(np.float64)).astype(np.int32) + 1

    def add(self, items) -> bool:
        if not items:
            return False
        reg, rank = self.places(items)
        before = self.registers.copy()
        np.maximum.at(self.registers, reg, rank.astype(np.uint8))
        return bool((before != self.registers).any())

    def merge(self, other: "Hll") -> None:
        self.registers = np.maximum(self.registers, other.registers)

    def count(self) -> int:
        return estimate(np.bincount(self.registers, minlength=self.Q + 2))

    def pack(self) -> bytes:
        bits = np.unpackbits(self.registers[:, None], axis=1, bitorder="little")[:, :6].ravel()
        return struct.pack("<Q", 12289) + np.packbits(bits, bitorder="little").tobytes() + b"\0"

    @classmethod
    def unpack(cls, raw: bytes) -> "Hll":
        if len(raw) != 8 + 12289 or struct.unpack("<Q", raw[:8])[0] != 12289:
            raise ValueError("bad image")
        bits = np.unpackbits(np.frombuffer(raw[8:-1], np.uint8), bitorder="little").reshape(-1, 6)
        return cls(np.packbits(np.pad(bits, ((0, 0), (0, 2))), axis=1, bitorder="little")[:, 0].copy())


def _sigma(x: float) -> float:
    if x == 1:
        return math.inf
    y, z = 1.0, x
    while True:
        x *= x
        last = z
        z += x * y
        y += y
        if z == last:
            return z


def _tau(x: float) -> float:
    if x in (0, 1):
        return 0.0
    y, z = 1.0, 1 - x
    while True:
        x = math.sqrt(x)
        last = z
        y *= 0.5
        z -= (1 - x) ** 2 * y
        if z == last:
            return z / 3


def estimate(histogram) -> int:
    """Ertl's improved raw estimator from the number of registers at each rank."""
    m, q = Hll.REGISTERS, Hll.Q
    z = m * _tau((m - float(histogram[q + 1])) / m)
    for rank in range(q, 0, -1):
        z = 0.5 * (z + float(histogram[rank]))
    z += m * _sigma(float(histogram[0]) / m)
    return math.floor(m * m / (2 * math.log(2)) / z + 0.5)


# ---- Count-Min and Morris


def cms_dims(error: float, probability: float) -> tuple[int, int]:
    """Width in double precision and depth in single precision; (0, 0) where there is none."""
    with np.errstate(all="ignore"):
        log = lambda x: np.float32(np.log10(np.float64(np.float32(x))))
        width, depth = math.ceil(2.0 / error) if error > 0 else 0, float(log(probability) / log(0.5)) if probability > 0 else math.nan
    if math.isnan(depth) or width < 1 or math.ceil(depth) < 1 or width > U32 or depth > U32:
        return 0, 0
    return width, math.ceil(depth)


def cells(items, width: int, depth: int) -> np.ndarray:
    """Column of every item in every row, shape (depth, items)."""
    return np.stack([murmur3_32(items, row).astype(np.int64) % width for row in range(depth)]) if len(items) else np.zeros((depth, 0), np.int64)


class Cms:
    def __init__(self, width: int, depth: int):
        self.width, self.depth, self.total = width, depth, 0
        self.table = np.zeros((depth, width), np.uint32)

    def add(self, item: bytes, n: int) -> int:
        at = cells([item], self.width, self.depth)[:, 0]
        rows = np.arange(self.depth)
        for row, col in zip(rows, at, strict=True):
            total = (int(self.table[row, col]) + n) & U32
            self.table[row, col] = U32 if total < n else total
        self.total = (self.total + n) & _MASK
        return int(self.table[rows, at].min())

    def count(self, item: bytes) -> int:
        return int(self.table[np.arange(self.depth), cells([item], self.width, self.depth)[:, 0]].min())

    def merge(self, sources: list["Cms"], weights: list[int]) -> bool:
        """False, and no change, where a counter or the total leaves its range."""
        limit = 1 << 63
        sums = np.zeros((self.depth, self.width), object)
        total = 0
        for s, w in zip(sources, weights, strict=True):
            product = s.table.astype(object) * w
            sums = sums + product
            total += s.total * w
            if not (-limit <= sums.min() and sums.max() < limit and -limit <= product.min() and product.max() < limit and -limit <= total < limit and s.total < limit):
                return False
        if sums.min() < 0 or sums.max() > U32 or total < 0:
            return False
        self.table, self.total = sums.astype(np.uint32), total
        return True

    def pack(self) -> bytes:
        return struct.pack("<IIQ", self.width, self.depth, self.total) + self.table.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Cms":
        width, depth, total = struct.unpack("<IIQ", raw[:16])
        out = cls(width, depth)
        out.total, out.table = total, np.frombuffer(raw[16:], "<u4").astype(np.uint32).reshape(depth, width)
        return out


MORRIS_A = 0.08
MORRIS_CHANCE = [math.pow(1 + MORRIS_A, -c) for c in range(256)]
MORRIS_VALUE = [math.floor((math.pow(1 + MORRIS_A, c) - 1) / MORRIS_A + 0.5) for c in range(256)]
MORRIS_ERROR = math.sqrt(MORRIS_A / 2)


class Morris:
    def __init__(self, width: int, depth: int):
        self.width, self.depth, self.total, self.state = width, depth, 0, _RNG_SEED
        self.table = np.zeros((depth, width), np.uint8)

    def _draw(self) -> float:
        self.state = _xorshift(self.state)
        return ((self.state >> 11) + 1) / (1 << 53)

    def add(self, item: bytes, n: int) -> int:
        """Waits between successes are geometric, so an increment costs at most 255 draws a row."""
        for row, col in enumerate(cells([item], self.width, self.depth)[:, 0]):
            c, left = int(self.table[row, col]), n
            while left > 0 and c < 255:
                p = MORRIS_CHANCE[c]
                skip = math.log(self._draw()) / math.log1p(-p) if p < 1 else 0.0
                if skip >= left:
                    break
                left -= int(skip) + 1
                c += 1
            self.table[row, col] = c
        self.total = (self.total + n) & _MASK
        return self.count(item)

    def count(self, item: bytes) -> int:
        at = self.table[np.arange(self.depth), cells([item], self.width, self.depth)[:, 0]]
        return MORRIS_VALUE[int(np.sort(at)[len(at) // 2])]

    def pack(self) -> bytes:
        return struct.pack("<IIQQ", self.width, self.depth, self.total, self.state) + self.table.tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Morris":
        width, depth, total, state = struct.unpack("<IIQQ", raw[:24])
        out = cls(width, depth)
        out.total, out.state, out.table = total, state, np.frombuffer(raw[24:], np.uint8).reshape(depth, width).copy()
        return out


# ---- Bloom


def bloom_shape(capacity: int, error: float) -> tuple[int, int, float]:
    """Bytes, number of hashes, bits an entry."""
    density = -math.log(error) / math.log(2) ** 2
    hashes = max(1, math.ceil(math.log(2) * density))
    wanted = capacity * density
    if wanted >= 1 << 62:
        return _MASK, hashes, density
    return max(1, (int(wanted) + 63) // 64) * 8, hashes, density


def bloom_bits(items, size: int, hashes: int) -> np.ndarray:
    """Bit positions of every item, shape (items, hashes)."""
    a, b = murmur3_128(items, FILTER_SEED)
    return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(size * 8)).astype(np.int64)


class BloomLink:
    def __init__(self, capacity: int, error: float):
        self.capacity, self.error, self.size = capacity, error, 0
        self.bytes, self.hashes, self.density = bloom_shape(capacity, error)
        self.table = np.zeros(self.bytes, np.uint8)


class FilterFull(Exception):
    pass


class FilterTooLarge(Exception):
    pass


class Bloom:
    """A chain of filters: each new one has ``expansion`` times the capacity and half the error; 0 never grows."""

    def __init__(self, capacity: int, error: float, expansion: int):
        if not 0 < error < 1 or bloom_shape(capacity, error)[0] > MAX_BYTES:
            raise FilterTooLarge
        self.links, self.size, self.expansion = [BloomLink(capacity, error)], 0, expansion

    @staticmethod
    def _has(link: BloomLink, item: bytes) -> bool:
        at = bloom_bits([item], link.bytes, link.hashes)[0]
        return bool((link.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).all())

    def has(self, item: bytes) -> bool:
        return any(self._has(link, item) for link in reversed(self.links))

    def add(self, item: bytes) -> bool:
        if self.has(item):
            return False
        link = self.links[-1]
        if link.size >= link.capacity:
            if not self.expansion:
                raise FilterFull
            capacity, error = min(link.capacity * self.expansion, _MASK), link.error * 0.5
            if not error or bloom_shape(capacity, error)[0] > MAX_BYTES:
                raise FilterTooLarge
            link = BloomLink(capacity, error)
            self.links.append(link)
        at = bloom_bits([item], link.bytes, link.hashes)[0]
        np.bitwise_or.at(link.table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        link.size += 1
        self.size += 1
        return True

    @property
    def capacity(self) -> int:
        return sum(x.capacity for x in self.links)

    def pack(self) -> bytes:
        out = struct.pack("<QQQ", self.size, self.expansion, len(self.links))
        for x in self.links:
            out += struct.pack("<QIQddQ", x.size, x.hashes, x.capacity, x.error, x.density, x.bytes * 8) + x.table.tobytes()
        return out

    @classmethod
    def unpack(cls, raw: bytes) -> "Bloom":
        out = cls.__new__(cls)
        out.size, out.expansion, links = struct.unpack("<QQQ", raw[:24])
        out.links, at = [], 24
        for _ in range(links):
            size, hashes, capacity, error, density, bits = struct.unpack("<QIQddQ", raw[at : at + 44])
            at += 44
            link = BloomLink.__new__(BloomLink)
            link.size, link.hashes, link.capacity, link.error, link.density, link.bytes = size, hashes, capacity, error, density, bits // 8
            link.table = np.frombuffer(raw[at : at + bits // 8], np.uint8).copy()
            at += bits // 8
            out.links.append(link)
        if at != len(raw):
            raise ValueError("bad image")
        return out


# ---- Cuckoo


class Cuckoo:
    SLOTS, KICKS, LOAD, DEFAULT = 4, 500, 0.95, 1024

    def __init__(self, capacity: int):
        needed = int(capacity / (self.SLOTS * self.LOAD)) + 1
        self.buckets = 1 << max(0, (needed - 1).bit_length())
        self.capacity, self.inserted, self.deleted, self.state = capacity, 0, 0, _RNG_SEED
        self.table = np.zeros(self.buckets * self.SLOTS, np.uint16)

    def _key(self, item: bytes) -> tuple[int, int, int]:
        """Fingerprint and both buckets."""
        h = int(murmur3_128([item], FILTER_SEED)[0][0])
        mark = h >> 48 or 1
        first = h & (self.buckets - 1)
        return mark, first, self._other(mark, first)

    def _other(self, mark: int, bucket: int) -> int:
        x = mark * _RNG_SEED & _MASK
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & _MASK
        return (bucket ^ x ^ x >> 32) & (self.buckets - 1)

    def _find(self, mark: int, bucket: int) -> int:
        """Slot that holds ``mark``, or -1."""
        at = np.flatnonzero(self.table[bucket * self.SLOTS : (bucket + 1) * self.SLOTS] == mark)
        return bucket * self.SLOTS + int(at[0]) if len(at) else -1

    def _put(self, mark: int, bucket: int) -> bool:
        slot = self._find(0, bucket)
        if slot >= 0:
            self.table[slot] = mark
            self.inserted += 1
        return slot >= 0

    def add(self, item: bytes) -> bool:
        mark, first, second = self._key(item)
        if self._put(mark, first) or self._put(mark, second):
            return True
        table, state = self.table.copy(), self.state
        self.state = _xorshift(self.state)
        bucket = second if self.state & 1 else first
        for _ in range(self.KICKS):
            self.state = _xorshift(self.state)
            slot = bucket * self.SLOTS + self.state % self.SLOTS
            mark, self.table[slot] = int(self.table[slot]), mark
            bucket = self._other(mark, bucket)
            if self._put(mark, bucket):
                return True
        self.table, self.state = table, state
        return False

    def has(self, item: bytes) -> bool:
        return self.count(item) > 0

    def count(self, item: bytes) -> int:
        mark, *places = self._key(item)
        return sum(int((self.table[b * self.SLOTS : (b + 1) * self.SLOTS] == mark).sum()) for b in set(places))

    def delete(self, item: bytes) -> bool:
        mark, *places = self._key(item)
        for bucket in places:
            slot = self._find(mark, bucket)
            if slot >= 0:
                self.table[slot] = 0
                self.deleted += 1
                return True
        return False

    def compact(self) -> None:
        self.inserted -= self.deleted
        self.deleted = 0

    def pack(self) -> bytes:
        return struct.pack("<6Q", self.buckets, self.inserted, self.deleted, self.capacity, self.state, len(self.table)) + self.table.astype("<u2").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "Cuckoo":
        out = cls.__new__(cls)
        out.buckets, out.inserted, out.deleted, out.capacity, out.state, slots = struct.unpack("<6Q", raw[:48])
        out.table = np.frombuffer(raw[48:], "<u2").astype(np.uint16)
        if len(out.table) != slots or slots != out.buckets * cls.SLOTS:
            raise ValueError("bad image")
        return out
