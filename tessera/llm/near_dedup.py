"""Near-duplicate groups from bottom-k sketches.

A document's set holds the distinct shingles of its folded words as 64-bit hashes; the ``k`` smallest are its sketch, so
one hash function serves all. Documents with equal sets form a class with one representative, and only
representatives go on.

Inverted lists of retained values make the candidates. A list stands for two neighbouring retained values, so that a
very common shingle alone joins nobody. If two sets of which a sketch holds all have similarity 0.8, the m values of
their union differ in at most m / 5, and each of these parts two pairs of neighbours at most: 0.6 m - 1 lists or more
are shared. Of larger sets the sketches see the k smallest values of the union; with k = 40 the probability that a link
shares fewer than ``NEED`` lists is below 7e-8, and the estimate below turns one away with less than 6e-9. ``k=None`` keeps whole sets as sketches and is exact.

Lists are ordered by length, shortest first. A representative leaves its ``NEED - AGREE`` longest lists, after which a
link still shares ``AGREE``. Lists of one member are never posted.

* Short lists (up to ``SHORT`` members) give pairs, and a pair needs ``AGREE`` shared lists, long ones included.
* Long lists are contracted: each member is compared with the pivot that it meets most often, confirmed links are
  followed to components, and lists inside one component are finished. What is left is compared in the tasks, block by
  block: a link that shares no short list shares ``AGREE`` long ones, so members of fewer than that are out, and each
  asks in its shortest lists only. The filters below and the sets themselves decide in the task, by the upper halves of
  the hashes, and only a forest of links leaves it. Should full sets not confirm one of these, whole sets decide anew.

Two filters stand before the full sets: the union-sketch estimate, and a parity bitmap (one bit for each residue of the
shingle hashes, flipped by every shingle). Two bitmaps differ in no more bits than the sets differ in shingles, so the
second never turns a link away. Full sets confirm every link. Components are found by alternating large-star and
small-star steps on the links. Nothing is collected; no list, pair or candidate is capped. Broadcasts are hinted only
for tables counted at ``BROADCAST`` rows or fewer; larger ones are joined by a shuffle.

Defined results: null texts and texts without words have an empty set, no links and their own id as component; a null
id ranks below none and is never a component's smallest id unless all are null; repeated rows are in one component;
tables without rows give none; a text of any length is taken whole, and needs some 40 bytes of memory a byte; extra
columns, whatever their names, are ignored by ``near_groups`` and kept by ``drop_near``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import Staging, fresh, partitions, whole_id

K, NEED, AGREE, SHORT, BLOCK = 40, 5, 3, 24, 512
#: Similarity 4/5 as a ratio, and how far an estimate from K values may lie below it.
NUMERATOR, DENOMINATOR, SLACK = 4, 5, 0.4
#: Rows that may be broadcast: some 100 bytes each in memory, so 13 MB at most.
BROADCAST = 1 << 17


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """Sorted distinct shingle hashes of every text of a chunk."""
    starts, ends, first = textkit.words(data, offsets, textkit.SPACE)
    h = textkit.word_hashes(data, starts, ends)
    n = len(first) - 1
    if len(h) >= width:
        rolled = h[: len(h) - width + 1].copy()
        for k in range(1, width):
            rolled = textkit.mix(rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.uint64(0x5851F42D4C957F2D)
            for x in h[a:b]:
                whole = textkit.mix(np.array([whole ^ x]))[0] + np.uint64(b - a)
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def _parity(own: np.ndarray) -> bytes:
    """A bit for each residue of the hashes, set if an odd number of them has it: 256 bits, or two to four a shingle."""
    bits = max(256, 1 << (2 * len(own) - 1).bit_length()) if len(own) else 256
    return np.packbits((np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (one a row) over fewer residues."""
    while bits.shape[1] > size:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _may_agree(bits_x: list[bytes], bits_y: list[bytes], total: np.ndarray) -> np.ndarray:
    """Which pairs differ in few enough bits; total: shingles of both sets."""
    a, b = np.array([len(x) for x in bits_x]), np.array([len(y) for y in bits_y])
    ok = np.zeros(len(a), bool)
    for s, t in {*zip(a.tolist(), b.tolist(), strict=True)}:
        at = np.flatnonzero((a == s) & (b == t))
        for some in np.array_split(at, max(1, len(at) * max(s, t) >> 24)):
            x = np.frombuffer(b"".join([bits_x[i] for i in some]), np.uint8).reshape(-1, s)
            y = np.frombuffer(b"".join([bits_y[i] for i in some]), np.uint8).reshape(-1, t)
            apart = np.bitwise_count(_fold(x, min(s, t)) ^ _fold(y, min(s, t))).sum(1, dtype=np.int64)
            ok[some] = (NUMERATOR + DENOMINATOR) * apart <= (DENOMINATOR - NUMERATOR) * total[some]
    return ok


def _estimate(sx: np.ndarray, sy: np.ndarray, k: int | None) -> bool:
    """Whether the share of the union's k smallest values that both sketches hold is near the similarity; exact when neither set exceeds k."""
    union = np.union1d(sx, sy)
    seen = len(union) if k is None else min(k, len(union))
    shared = np.intersect1d(sx, sy, assume_unique=True)
    slack = SLACK * (k is not None and max(len(sx), len(sy)) >= k)
    return int((shared <= union[seen - 1]).sum()) >= (NUMERATOR / DENOMINATOR - slack) * seen - 1e-9


def _arrays(column) -> list[np.ndarray]:
    """The rows of a list<long> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


_SKETCHED = "_rid long, _id long, _hash long, _n long, _set binary, _sketch array<long>, _bits binary"


def _sketches(width: int, k: int | None):
    def run(batches):
        schema = pa.schema([("_rid", pa.int64()), ("_id", pa.int64()), ("_hash", pa.int64()), ("_n", pa.int64()), ("_set", pa.binary()), ("_sketch", pa.list_(pa.int64())), ("_bits", pa.binary())])
        for batch in batches:
            for row, n, data, offsets in textkit.chunks(batch.column("_text"), textkit.CHUNK >> 2):
                sizes, keys, sketches, bits, ends = [], [], [], [], [0]
                for own in shingle_sets(data, offsets, width):
                    sizes.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    sketches.append(own[:k])
                    bits.append(_parity(own))
                    ends.append(ends[-1] + len(sketches[-1]))
                values = np.concatenate(sketches).view(np.int64)
                yield textkit.output(schema, [
                    batch.column("_rid").slice(row, n), batch.column("_id").slice(row, n), batch.column("_hash").slice(row, n), np.array(sizes, np.int64), pa.array(keys, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values)), pa.array(bits, pa.binary()),
                ])

    return run


def _neighbours(batches):
    """A row for every two neighbouring values of a sketch."""
    schema = pa.schema([("_value", pa.int64()), ("_c", pa.int64()), ("_n", pa.int64())])
    for batch in batches:
        column = batch.column("_sketch")
        offsets = column.offsets.to_numpy()
        values = column.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key = textkit.mix(values[inner] * np.uint64(0x9E3779B97F4A7C15) + values[inner + 1]).view(np.int64)
        c, n = batch.column("_c").to_numpy()[owner[inner]], batch.column("_n").to_numpy()[owner[inner]]
        for at in range(0, len(key), 1 << 16):
            s = slice(at, at + (1 << 16))
            yield textkit.output(schema, [key[s], c[s], n[s]])


def _full_sets(width: int):
    def run(batches):
        schema = pa.schema([("_c", pa.int64()), ("_full", pa.binary()), ("_half", pa.binary())])
        for batch in batches:
            for row, n, data, offsets in textkit.chunks(batch.column("_text"), textkit.CHUNK >> 2):
                sets = list(shingle_sets(data, offsets, width))
                halves = [np.unique(own >> np.uint64(32)).astype(np.uint32).tobytes() for own in sets]
                yield textkit.output(schema, [batch.column("_c").slice(row, n), pa.array([own.tobytes() for own in sets], pa.binary()), pa.array(halves, pa.binary())])

    return run


_PAIR = pa.schema([("_x", pa.int64()), ("_y", pa.int64())])


def _alike(p: np.ndarray, q: np.ndarray) -> bool:
    shared = len(np.intersect1d(p, q, assume_unique=True))
    return DENOMINATOR * shared >= NUMERATOR * (len(p) + len(q) - shared)


def _similar(batches):
    """Pairs whose full sets reach the similarity."""
    for batch in batches:
        ok = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("_full_x"), batch.column("_full_y"), strict=True)]
        yield textkit.output(_PAIR, [batch.column("_x"), batch.column("_y")]).filter(pa.array(ok, pa.bool_()))


def _plausible(k: int | None):
    def run(batches):
        for batch in batches:
            total = batch.column("_n_x").to_numpy() + batch.column("_n_y").to_numpy()
            ok = _may_agree(batch.column("_bits_x").to_pylist(), batch.column("_bits_y").to_pylist(), total)
            a, b = _arrays(batch.column("_sketch_x")), _arrays(batch.column("_sketch_y"))
            for i in np.flatnonzero(ok):
                ok[i] = _estimate(a[i], b[i], k)
            yield textkit.output(_PAIR, [batch.column("_x"), batch.column("_y")]).filter(pa.array(ok, pa.bool_()))

    return run


def _grid(members: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Which of the (sorted) values each member holds."""
    out = np.zeros((len(members), len(values)), np.float32)
    if len(values):
        for i, own in enumerate(members):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            out[i, at[values[at] == own]] = 1
    return out


class _Block:
    """Members of a list: class, label, set (whole or its halves), lists, and parity bitmaps by their size."""

    def __init__(self, members, k):
        self.c, self.label, self.sets, self.lists = (list(x) for x in zip(*members, strict=True))
        self.n = np.array([len(x) for x in self.sets])
        self.sketch = [x[:k] for x in self.sets]
        parity = [_parity(x) for x in self.sets]
        self.bits = np.array([len(x) for x in parity])
        self.rows = {s: np.flatnonzero(self.bits == s) for s in set(self.bits.tolist())}
        self.parity = {s: np.frombuffer(b"".join(parity[i] for i in own), np.uint8).reshape(-1, s) for s, own in self.rows.items()}

    def near(self, i: int, other: _Block) -> np.ndarray:
        """Members of the other block that differ in few enough bits from the i-th."""
        own, found = int(self.bits[i]), []
        row = self.parity[own][np.searchsorted(self.rows[own], i)][None]
        for s, places in other.rows.items():
            size = min(s, own)
            apart = np.bitwise_count((_fold(other.parity[s], size) ^ _fold(row, size)).view(np.uint64)).sum(1, dtype=np.int64)
            found.append(places[(NUMERATOR + DENOMINATOR) * apart <= (DENOMINATOR - NUMERATOR) * (self.n[i] + other.n[places])])
        return np.concatenate(found)


def _compare(value, asked, given, k):
    """Links of one block that join different labels: a forest, as one path between two labels is enough. A pair is looked at in the smallest open list that both ask in."""
    x, y = _Block(asked, k), _Block(given, k)
    apart = np.array(x.label)[:, None] != np.array(y.label)[None]
    lists, count = np.unique(np.concatenate([*x.lists, *y.lists]), return_counts=True)
    lists = lists[(lists < np.int64(value).view(np.uint64)) & (count > 1)]
    if len(lists):
        apart &= _grid(x.lists, lists) @ _grid(y.lists, lists).T == 0
    root: dict[int, int] = {}

    def find(label):
        while root.setdefault(label, label) != label:
            root[label] = label = root[root[label]]
        return label

    for i in np.flatnonzero(apart.any(1)).tolist():
        near = x.near(i, y)
        for j in near[apart[i, near]].tolist():
            a, b = find(x.label[i]), find(y.label[j])
            if a != b and _estimate(x.sketch[i], y.sketch[j], k) and _alike(x.sets[i], y.sets[j]):
                root[a] = b
                yield (x.c[i], y.c[j]) if x.c[i] < y.c[j] else (y.c[j], x.c[i])


def _long_lists(k: int | None, dtype):
    """Rows come sorted by list and block: the asked members of a block are compared with its given ones."""

    def finish(key, asked, given):
        found = set(_compare(key[0], asked, given, k)) if asked and given else set()
        if found:
            pairs = np.array(sorted(found), np.int64)
            yield textkit.output(_PAIR, [pairs[:, 0], pairs[:, 1]])

    def run(batches):
        key, asked, given = None, [], []
        for batch in batches:
            columns = *(batch.column(x).to_pylist() for x in ("_value", "_block", "_ask", "_c", "_label", "_set")), _arrays(batch.column("_lists"))
            for value, block, ask, c, label, own, lists in zip(*columns, strict=True):
                if (value, block) != key:
                    yield from finish(key, asked, given)
                    key, asked, given = (value, block), [], []
                (asked if ask else given).append((c, label, np.frombuffer(own, dtype), np.sort(lists)))
                if len(asked) >= BLOCK:
                    yield from finish(key, asked, given)
                    asked = []
        yield from finish(key, asked, given)

    return run


def fitting(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if it has few rows; it must be a written table of narrow rows."""
    return F.broadcast(small) if small.limit(BROADCAST + 1).count() <= BROADCAST else small


class _Job:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, k: int | None):
        self.spark = docs.sparkSession
        self.staging = Staging(self.spark, "near")
        self.width, self.k = width, k
        self.names: list[str] = []
        self.rows = docs.select(whole_id(docs, id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
        keyed = self.rows.withColumn("_rid", F.monotonically_increasing_id()).mapInArrow(_sketches(width, k), _SKETCHED)
        self.all = self.staging.put(keyed, "sketches")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self.names.append(f"{len(self.names)}-{name}")
        return self.staging.put(df, self.names[-1])

    def free(self, keep: int = 0) -> None:
        """Frees the tables that were written, but for the last ``keep``."""
        self.staging.drop(*self.names[: len(self.names) - keep])

    def classes(self) -> None:
        own = self.all.where("_n > 0").groupBy("_set").agg(F.min("_rid").alias("_c"), F.min("_id").alias("_least"))
        self.members = self.staging.put(own, "classes")
        # sets of up to three shingles have no links but to equal ones
        s = self.all.where("_n > 3").select("_rid", "_n", "_sketch", "_bits")
        self.reps = self.put(s.join(self.members.select("_c"), F.col("_rid") == F.col("_c"), "left_semi").withColumnRenamed("_rid", "_c"), "reps")

    def postings(self) -> None:
        """lists (_value, _c, _n, _agree, _size, _long): the lists that each representative stands in, and how many of them are long."""
        keys = self.reps.select("_c", "_n", "_sketch").mapInArrow(_neighbours, "_value long, _c long, _n long")
        shared = self.put(keys.groupBy("_value").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1").withColumnRenamed("_value", "_v"), "shared")
        common = keys.join(shared, F.col("_value") == F.col("_v")).groupBy("_c", "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "_value"))).alias("_held"))
        need = F.least(F.expr("(3 * _n - 1) div 5"), F.lit(NEED))
        agree = F.least(F.lit(AGREE), need)
        every = F.col("_n") - 1 if self.k is None else F.least(F.col("_n"), F.lit(self.k)) - 1
        take = F.greatest(F.lit(0), every - need + agree - (every - F.size("_held"))).cast("int")
        common = common.select("_c", "_n", agree.cast("int").alias("_agree"), F.col("_held"), take.alias("_take")).where("_take > 0")
        posted = common.select("_c", "_n", "_agree", F.explode(F.slice("_held", F.lit(1), F.col("_take"))).alias("_p"))
        posted = self.put(posted.select(F.col("_p._value").alias("_value"), "_c", "_n", "_agree"), "posted")
        sizes = posted.groupBy("_value").agg(F.count(F.lit(1)).alias("_size"), F.min("_c").alias("_pivot")).where("_size > 1").withColumnRenamed("_value", "_v")
        lists = posted.join(sizes, F.col("_value") == F.col("_v")).drop("_v")
        lists = self.put(lists, "lists")
        long = lists.where(F.col("_size") > SHORT).groupBy(F.col("_c").alias("_k")).agg(F.count(F.lit(1)).alias("_long"))
        self.lists = self.put(lists.join(long, F.col("_c") == F.col("_k"), "left").drop("_k").withColumn("_long", F.coalesce("_long", F.lit(0))), "weighed")

    def short_pairs(self) -> DataFrame:
        short = self.lists.where(F.col("_size") <= SHORT)
        a, b = (short.select(F.col("_value").alias(f"_v{k}"), F.col("_c").alias(k), F.col("_n").alias(f"_n{k}"), F.col("_agree").alias(f"_g{k}"), F.col("_long").alias(f"_l{k}")) for k in ("_x", "_y"))
        near = (F.col("_n_x") * DENOMINATOR >= F.col("_n_y") * NUMERATOR) & (F.col("_n_y") * DENOMINATOR >= F.col("_n_x") * NUMERATOR)
        pairs = a.join(b, (F.col("_v_x") == F.col("_v_y")) & (F.col("_x") < F.col("_y")) & near)
        short_of = F.min(F.least("_g_x", "_g_y") - F.least("_l_x", "_l_y"))
        return pairs.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_s"), short_of.alias("_g")).where("_s >= _g").select("_x", "_y")

    def pivot_pairs(self) -> DataFrame:
        """Each member of long lists with the pivot (smallest member) that it meets most often."""
        long = self.lists.where((F.col("_size") > SHORT) & (F.col("_c") != F.col("_pivot")))
        met = long.groupBy("_c", "_pivot").agg(F.count(F.lit(1)).alias("_s")).where("_s > 1")
        best = met.groupBy("_c").agg(F.max(F.struct(F.col("_s"), (-F.col("_pivot")).alias("_p"))).alias("_b"))
        return best.select((-F.col("_b._p")).alias("_x"), F.col("_c").alias("_y"))

    def plausible(self, pairs: DataFrame) -> DataFrame:
        out = pairs
        for k in ("_x", "_y"):
            own = self.reps.select(F.col("_c"), F.col("_n").alias(f"_n{k}"), F.col("_sketch").alias(f"_sketch{k}"), F.col("_bits").alias(f"_bits{k}"))
            out = out.join(own, F.col(k) == F.col("_c")).drop("_c")
        return out.mapInArrow(_plausible(self.k), "_x long, _y long")

    def load_sets(self, wanted: DataFrame) -> None:
        """Full sets of the representatives in ``wanted`` (_c), made from their texts."""
        keys = self.all.select(F.col("_rid").alias("_c"), F.col("_id").alias("_i"), F.col("_hash").alias("_h"))
        keys = self.put(keys.join(wanted.withColumnRenamed("_c", "_w"), F.col("_c") == F.col("_w"), "left_semi"), "wanted")
        texts = self.rows.join(fitting(keys), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_c", "_text")
        # rows that agree in id and text are one representative
        if not self.all.groupBy("_id", "_hash").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").isEmpty():
            texts = texts.dropDuplicates(["_c"])
        self.sets = self.put(texts.mapInArrow(_full_sets(self.width), "_c long, _full binary, _half binary"), "sets")

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        out = pairs
        for k in ("_x", "_y"):
            out = out.join(self.sets.select("_c", F.col("_full").alias(f"_full{k}")), F.col(k) == F.col("_c")).drop("_c")
        return self.put(out.mapInArrow(_similar, "_x long, _y long").distinct(), name)

    def components(self, links: DataFrame, name: str) -> DataFrame:
        """(_v, _label): every linked node with the smallest node that it reaches."""
        edges, last = self.put(links.select(F.greatest("_x", "_y").alias("_v"), F.least("_x", "_y").alias("_u")).distinct(), f"{name}-edges"), None
        while True:
            both = edges.unionByName(edges.select(F.col("_u").alias("_v"), F.col("_v").alias("_u")))
            least = both.groupBy(F.col("_v").alias("_k")).agg(F.min("_u").alias("_m")).select("_k", F.least("_k", "_m").alias("_m"))
            large = both.join(least, F.col("_v") == F.col("_k")).where("_u > _v").select(F.col("_u").alias("_v"), F.col("_m").alias("_u"))
            large = self.put(large.where("_v != _u").distinct(), f"{name}-large")
            least = large.groupBy(F.col("_v").alias("_k")).agg(F.min("_u").alias("_m"))
            small = large.join(least, F.col("_v") == F.col("_k"))
            small = small.select(F.when(F.col("_u") == F.col("_m"), F.col("_v")).otherwise(F.col("_u")).alias("_v"), F.col("_m").alias("_u"))
            edges = self.put(small.where("_v != _u").distinct(), f"{name}-small")
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_v", "_u").cast("decimal(38,0)"))).first()
            if state == last:
                return edges.select("_v", F.col("_u").alias("_label"))
            last = state

    def open_lists(self, labels: DataFrame | None) -> DataFrame:
        """Long lists whose members have more than one label, with the members that can have a link there, each in its shortest lists."""
        long = self.lists.where((F.col("_size") > SHORT) & (F.col("_long") >= F.col("_agree")))
        if labels is None:
            long = long.withColumn("_label", F.col("_c"))
        else:
            long = long.join(labels, F.col("_c") == F.col("_v"), "left").withColumn("_label", F.coalesce("_label", "_c")).drop("_v")
        own = long.groupBy("_c", "_n", "_label", "_agree").agg(F.sort_array(F.collect_list(F.struct("_size", "_value"))).alias("_held"))
        own = own.withColumn("_held", F.slice("_held", F.lit(1), F.size("_held") - F.col("_agree") + 1))
        asked = own.select("_c", "_n", "_label", F.col("_held._value").alias("_lists"), F.explode("_held._value").alias("_value"))
        some = asked.groupBy(F.col("_value").alias("_v")).agg(F.min("_label").alias("_a"), F.max("_label").alias("_b")).where("_a != _b").select("_v")
        return asked.join(some, F.col("_value") == F.col("_v"), "left_semi")

    def residual(self, lists: DataFrame, whole: bool) -> DataFrame:
        """Links between different labels inside long lists, found block by block from whole sets or from the upper halves of their hashes."""
        sizes = lists.groupBy(F.col("_value"), "_label").agg(F.count(F.lit(1)).alias("_m")).groupBy(F.col("_value").alias("_v")).agg(F.sum("_m").alias("_all"), F.max(F.struct("_m", "_label")).alias("_top"))
        placed = lists.join(sizes, F.col("_value") == F.col("_v")).withColumn("_blocks", F.ceil(F.col("_all") / BLOCK).cast("int")).withColumn("_outside", F.col("_label") != F.col("_top._label"))
        sets = self.sets.select(F.col("_c").alias("_r"), F.col("_full" if whole else "_half").alias("_set"))
        placed = placed.select("_value", "_c", "_label", "_lists", "_blocks", "_outside").join(sets, F.col("_c") == F.col("_r")).drop("_r")
        row = ["_c", "_label", "_set", "_lists"]
        given = placed.select("_value", F.pmod(F.xxhash64("_c"), F.col("_blocks")).cast("int").alias("_block"), F.lit(False).alias("_ask"), *row)
        asked = placed.where("_outside").select("_value", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"), F.lit(True).alias("_ask"), *row)
        rows = given.unionByName(asked).repartition(partitions(self.spark), "_value", "_block").sortWithinPartitions("_value", "_block", "_ask")
        return rows.mapInArrow(_long_lists(self.k, np.uint64 if whole else np.uint32), "_x long, _y long").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, k: int | None) -> tuple[_Job, DataFrame]:
    """The job, and one row per document: _id, _hash (of the text), _n, _label (null without words), _component."""
    job = _Job(docs, id_col, text_col, width, k)
    job.classes()
    job.postings()
    pairs = job.put(job.plausible(job.short_pairs().unionByName(job.pivot_pairs()).distinct()), "pairs")
    long = job.lists.where((F.col("_size") > SHORT) & (F.col("_long") >= F.col("_agree"))).select("_c")
    job.load_sets(pairs.select(F.col("_x").alias("_c")).union(pairs.select("_y")).union(long).distinct())
    links = job.confirm(pairs, "links")
    labels = job.components(links, "first") if not links.isEmpty() else None
    for whole in (False, True):
        still = job.put(job.open_lists(labels), f"open-{whole}")
        if still.isEmpty():
            break
        rest = job.put(job.residual(still, whole), f"rest-{whole}")
        found = job.confirm(rest, f"found-{whole}")
        n = found.count()
        if n:
            known = links if labels is None else labels.select(F.col("_v").alias("_x"), F.col("_label").alias("_y"))
            labels = job.components(known.unionByName(found), f"second-{whole}")
        if n == rest.count():
            break
        # halves took two texts for similar that are not, and may have left out a path for it
    classes = job.members.join(labels, F.col("_c") == F.col("_v"), "left").select("_set", F.coalesce("_label", "_c").alias("_label"), "_least") if labels is not None else job.members.select("_set", F.col("_c").alias("_label"), "_least")
    classes = job.put(classes, "labelled")
    least = classes.groupBy(F.col("_label").alias("_l")).agg(F.min("_least").alias("_component"))
    classes = job.put(classes.join(least, F.col("_label") == F.col("_l")).select(F.col("_set").alias("_s"), "_label", "_component"), "component")
    job.free(keep=1)
    return job, job.all.select("_id", "_hash", "_n", "_set").join(classes, (F.col("_set") == F.col("_s")) & (F.col("_n") > 0), "left")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int | None = K) -> DataFrame:
    """One row per document: ``id_col``, n_shingles, component_id, kept. width: words of a shingle; k: values of a sketch, None for exact candidates."""
    _, out = _components(docs, id_col, text_col, width, k)
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int | None = K) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component (smallest id, null last, then text hash), and all without words."""
    job, out = _components(docs, id_col, text_col, width, k)
    rank = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    members = job.put(out.where("_n > 0").groupBy("_id", "_hash", "_label").agg(F.count(F.lit(1)).alias("_rows")), "members")
    first = members.groupBy(F.col("_label").alias("_l")).agg(F.min(rank).alias("_first"))
    verdicts = members.join(first, F.col("_label") == F.col("_l")).select(F.col("_id").alias("_near_id"), F.col("_hash").alias("_near_hash"), "_rows", (rank == F.col("_first")).alias("_stays"))
    verdicts = job.put(verdicts.where("not _stays or _rows > 1"), "verdicts")
    own, near_id, near_hash = F.xxhash64(F.coalesce(docs[text_col], F.lit(""))), fresh(docs, "_near_id"), fresh(docs, "_near_hash")
    verdicts = verdicts.withColumnsRenamed({"_near_id": near_id, "_near_hash": near_hash})
    same = docs[id_col].cast("long").eqNullSafe(F.col(near_id)) & (own == F.col(near_hash))
    single = docs.join(fitting(verdicts.select(near_id, near_hash)), same, "left_anti")
    repeated = verdicts.where("_stays").select(near_id, near_hash)
    if repeated.isEmpty():
        return single
    again = docs.join(fitting(repeated), same, "left_semi").withColumn(near_hash, own)
    return single.unionByName(again.dropDuplicates([id_col, near_hash]).drop(near_hash))
