"""Benchmark decontamination with an FM-index per shard of training text.

A window is ``width`` consecutive words of a benchmark item; a shorter item is one window. The words of the windows
form the alphabet. Each task reads documents into shards of bounded size. A shard's sequence holds every run of
alphabet words that is as long as the shortest window, with a separator after each run; no other text can hold an
occurrence. The shard is indexed once: suffix array, Burrows-Wheeler transform, wavelet matrix with prefix ranks, and
suffix positions sampled at every run start and every eighth word. All windows are searched backward at once,
occurrences are located through the samples, and overlapping ones are merged into removal spans.

Nothing is shuffled. The windows travel to the executors in blocks of at most ``block_words`` benchmark words; a
larger benchmark is searched block after block over the same rows.

Defined results: null texts and items have no words; an item without words gives no window; items that share an id
are one item and a null id is written "null"; repeated documents and null document ids get a row each; a table without
rows gives none; a text of any length is searched whole, in a shard of its own if need be, with some 40 bytes of memory a
byte; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import whole_id

#: Words of a shard's sequence, and bytes of text read for a shard, before it is indexed.
SHARD_WORDS, SHARD_BYTES = 1 << 18, 1 << 25
SAMPLE = 8


class WaveletMatrix:
    """Rank queries over a sequence of symbols, one level a bit, top bit first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for level in range(bits - 1, -1, -1):
            ones = ((symbols >> level) & 1).astype(bool)
            below = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~ones, out=below[1:])
            self.levels.append((below, below[-1]))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position ``at``."""
        base = np.zeros_like(at)
        for i, (below, zeros) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            low, base_low = below[at], below[base]
            at = np.where(one, zeros + at - low, low)
            base = np.where(one, zeros + base - base_low, base_low)
        return at - base


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; 0 is a separator, and no two separators are equal."""
    n = len(symbols)
    gaps = symbols == 0
    rank = symbols.astype(np.int64) + n
    rank[gaps] = np.arange(int(gaps.sum()))
    step = 0
    while True:
        if step:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (n + 1) + after
        else:
            key = rank
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step = max(1, step * 2)


class FMIndex:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        """symbols: starts with a 0 and ends with one; 0 separates runs."""
        order = suffix_array(symbols)
        before = symbols[order - 1]
        self.n = len(symbols)
        self.before = before
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet + 1))]).astype(np.int64)
        self.wavelet = WaveletMatrix(before, max(1, int(alphabet).bit_length()))
        place = np.arange(self.n)
        sampled = (place % SAMPLE == 0) | (symbols[place - 1] == 0) | (symbols == 0)
        self.sample = np.where(sampled[order], order, -1)

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [low, high) of each row of ``windows``, by backward steps."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        alive = np.arange(len(windows))
        for at in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, at]
            base = self.below[symbol]
            low[alive], high[alive] = base + self.wavelet.rank(symbol, low[alive]), base + self.wavelet.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(low, high)
        gone = np.ones(len(windows), bool)
        gone[alive] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes: step back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(self.sample[at] < 0)
        while len(todo):
            symbol = self.before[at[todo]]
            at[todo] = self.below[symbol] + self.wavelet.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[self.sample[at[todo]] < 0]
        return self.sample[at] + steps


class Benchmark:
    """Windows of some items: the alphabet, the windows by length, and the items of each window."""

    def __init__(self, rows: list[tuple[str, str]], width: int):
        self.words: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in rows:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in (text or "").encode().translate(textkit.NORM).split()]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.shortest = min(map(len, found), default=0)
        self.groups = []
        for size in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == size]
            self.groups.append((np.array(own, np.int64), [sorted(found[w]) for w in own]))


class _Shard:
    def __init__(self, bench: Benchmark):
        self.bench, self.parts, self.rows, self.places, self.size, self.bytes = bench, [], [], [], 1, 0
        self.counts: list[int] = []

    def add(self, raw: bytes) -> None:
        words = raw.translate(textkit.NORM).split()
        row = len(self.counts)
        self.counts.append(len(words))
        self.bytes += len(raw)
        if len(words) < self.bench.shortest or not self.bench.shortest:
            return
        get = self.bench.words.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], ids != 0, [0]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.bench.shortest:
                self.parts += [ids[a:b], np.zeros(1, np.int64)]
                self.rows.append((row, a, self.size, b - a))
                self.size += b - a + 1

    def search(self) -> tuple[list[list[int]], list[list[str]]]:
        """Merged spans (start, end, start, end ...) in words and the items found, for each row."""
        spans: list[list[int]] = [[] for _ in self.counts]
        items: list[list[str]] = [[] for _ in self.counts]
        if not self.parts:
            return spans, items
        symbols = np.concatenate([np.zeros(1, np.int64), *self.parts])
        index = FMIndex(symbols, len(self.bench.words))
        runs = np.array(self.rows, np.int64)
        cover = np.zeros(len(symbols) + 1, np.int64)
        found: list[set[str]] = [set() for _ in self.counts]
        for windows, owners in self.bench.groups:
            low, high = index.search(windows)
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            count = (high - low)[hit]
            which = np.repeat(hit, count)
            rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
            place = index.locate(rows)
            np.add.at(cover, place, 1)
            np.add.at(cover, place + windows.shape[1], -1)
            row = runs[np.searchsorted(runs[:, 2], place, side="right") - 1, 0]
            for r, w in np.unique(np.stack([row, which], 1), axis=0).tolist():
                found[r].update(owners[w])
        inside = (np.cumsum(cover) > 0).astype(np.int8)
        edges = np.flatnonzero(np.diff(inside, prepend=0))
        run = np.searchsorted(runs[:, 2], edges[::2], side="right") - 1
        for k, a, b in zip(run.tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            row, first, at, _ = runs[k].tolist()
            spans[row] += [first + a - at, first + b - at]
        return spans, [sorted(x) for x in found]


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _search(bench: Benchmark, keep_text: bool):
    fields = [("_id", pa.int64()), ("_n_words", pa.int64()), ("_spans", pa.list_(pa.int64())), ("_items", pa.list_(pa.string()))] + ([("_text", pa.string())] if keep_text else [])
    schema = pa.schema(fields)

    def run(batches):
        held, shard = [], _Shard(bench)

        def flush():
            nonlocal held, shard
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                spans, items = shard.search()
                spans = [_merged(a + b) if a else b for a, b in zip(rows.column("_spans").to_pylist(), spans, strict=True)]
                items = [sorted({*a, *b}) if a else b for a, b in zip(rows.column("_items").to_pylist(), items, strict=True)]
                columns = [rows.column("_id"), shard.counts, spans, items] + ([rows.column("_text")] if keep_text else [])
                yield textkit.output(schema, columns)
            held, shard = [], _Shard(bench)

        for batch in batches:
            start, at = 0, 0
            for raw in textkit.texts(batch.column("_text")):
                shard.add(raw)
                at += 1
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                    held.append((batch if keep_text else batch.select(["_id", "_spans", "_items"])).slice(start, at - start))
                    start = at
                    yield from flush()
            if at > start:
                held.append((batch if keep_text else batch.select(["_id", "_spans", "_items"])).slice(start, at - start))
        yield from flush()

    return run


def benchmark_blocks(benchmark: DataFrame, width: int, block_words: int) -> list[Benchmark]:
    """The benchmark in blocks of about ``block_words`` words, each read on its own."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("_item"), F.col("text").alias("_text"))
    total = rows.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / 5 / block_words))
    part = F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))
    return [Benchmark([tuple(r) for r in rows.where(part == i).collect()], width) for i in range(blocks)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """One row per document: ``id_col``, n_words, spans (word offsets start, end, start, end ...), items."""
    rows = docs.select(
        whole_id(docs, id_col).alias("_id"), F.lit(0).cast("long").alias("_n_words"), F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("_items"), F.col(text_col).alias("_text")
    )
    blocks = benchmark_blocks(benchmark, width, block_words)
    for i, bench in enumerate(blocks):
        more = i + 1 < len(blocks)
        rows = rows.mapInArrow(_search(bench, more), "_id long, _n_words long, _spans array<long>, _items array<string>" + ", _text string" * more)
    return rows.select(F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items"))


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 10) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_contamination(docs, benchmark, id_col, text_col, width)
    signed = F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def _clean(bench: Benchmark, text_at: int):
    def run(batches):
        held, shard = [], _Shard(bench)

        def flush():
            nonlocal held, shard
            if held:
                spans, _ = shard.search()
                clean, at = pa.array([not x for x in spans], pa.bool_()), 0
                for part in held:
                    yield part.filter(clean.slice(at, part.num_rows))
                    at += part.num_rows
            held, shard = [], _Shard(bench)

        for batch in batches:
            start, at = 0, 0
            for raw in textkit.texts(batch.column(text_at)):
                shard.add(raw)
                at += 1
                if shard.size >= SHARD_WORDS or shard.bytes >= SHARD_BYTES:
                    held.append(batch.slice(start, at - start))
                    start = at
                    yield from flush()
            if at > start:
                held.append(batch.slice(start, at - start))
        yield from flush()

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 10, block_words: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of the benchmark."""
    for bench in benchmark_blocks(benchmark, width, block_words):
        docs = docs.mapInArrow(_clean(bench, docs.columns.index(text_col)), docs.schema)
    return docs
