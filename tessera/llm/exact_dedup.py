"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition folds its rows into one run: sorted keys, each with the identifier that stays and a count.
Runs are then exchanged in binomial rounds: in round r the partitions whose numbers differ in the r-th bit alone are
partners, each keeps the half of its run whose keys have its own bit and sends the other half, and the two sorted runs
that it then holds are merged, one step a key. After the last round a partition's number equals the leading bits of
every key it holds, so each key stands in exactly one run. Copies meet as early as possible: a partition never sends
more than one entry a key, so a group that holds a third of all rows costs one entry for each partition and round.

Keys are verified: the SHA-256 of the folded text is joined by its length and an independent 64-bit hash, and all
three must agree before two entries count as equal.

Defined results: a null text counts as the empty text; a null id ranks below every id; rows that agree in id and text
are ranked by their position in the scan, so exactly one row of a group is kept; an empty table gives no rows; a text of
any length is taken whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import Staging, partitions, whole_id

KEY = 48
_DIGESTS = "_id long, _rid long, _key binary"
_RUN = "_dest int, _from int, _key binary, _id long, _rid long, _n long"


def _digest(batches):
    schema = pa.schema([("_id", pa.int64()), ("_rid", pa.int64()), ("_key", pa.binary())])
    for batch in batches:
        keys = []
        for raw in textkit.texts(batch.column(2)):
            text = raw.translate(textkit.FOLD)
            keys.append(hashlib.sha256(text).digest() + len(text).to_bytes(8, "big") + xxhash.xxh3_64_digest(text))
        yield textkit.output(schema, [batch.column(0), batch.column(1), pa.array(keys, pa.binary())])


class _Tree:
    """Partitions, a power of two, whose partners in round r differ in bit ``rounds - 1 - r``."""

    def __init__(self, wanted: int):
        self.rounds = max(1, math.ceil(math.log2(max(2, wanted))))
        self.size = 1 << self.rounds

    def send(self, keys: np.ndarray, holder: int, r: int) -> np.ndarray:
        """Where each entry stands after round r: the holder's bit becomes the key's."""
        lead = np.frombuffer(keys.tobytes(), ">u4").reshape(len(keys), KEY // 4)[:, 0].astype(np.int64)
        shift = self.rounds - 1 - r
        return (holder & ~(1 << shift)) | (((lead >> (31 - r)) & 1) << shift)


class _Run(NamedTuple):
    """Entries sorted by key, one a key."""

    keys: np.ndarray
    ids: np.ndarray
    missing: np.ndarray
    rids: np.ndarray
    counts: np.ndarray

    def at(self, places) -> _Run:
        return _Run(*(x[places] for x in self))


def _fold(rows: _Run, largest: bool) -> _Run:
    """A run of unsorted rows."""
    rows = rows.at(np.lexsort((rows.rids, ~rows.ids if largest else rows.ids, rows.missing, rows.keys)))
    first = np.flatnonzero(np.concatenate([[True], rows.keys[1:] != rows.keys[:-1]]))
    return rows.at(first)._replace(counts=np.add.reduceat(rows.counts, first))


def _merge(a: _Run, b: _Run, largest: bool) -> _Run:
    """Two runs as one: each entry's place is its own plus the number of smaller entries of the other run."""
    n = len(a.keys) + len(b.keys)
    place_a = np.arange(len(a.keys)) + np.searchsorted(b.keys, a.keys, "left")
    place_b = np.arange(len(b.keys)) + np.searchsorted(a.keys, b.keys, "right")
    both = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(n, x.dtype)
        z[place_a], z[place_b] = x, y
        both.append(z)
    both = _Run(*both)
    again = np.flatnonzero(both.keys[1:] == both.keys[:-1])
    x, y = both.at(again), both.at(again + 1)
    id_first = np.where(largest, y.ids < x.ids, x.ids < y.ids)
    x_stays = np.where(x.missing != y.missing, y.missing, np.where(x.ids != y.ids, id_first, x.rids < y.rids))
    both.counts[again] += both.counts[again + 1]
    both.counts[again + 1] = both.counts[again]
    keep = np.ones(n, bool)
    keep[again + x_stays] = False
    return both.at(keep)


def _multiway(runs: list[_Run], largest: bool) -> _Run:
    """All runs as one, by a tournament of merges."""
    while len(runs) > 1:
        runs = [_merge(runs[i], runs[i + 1], largest) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _entries(batch) -> _Run:
    ids = batch.column("_id")
    counts = batch.column("_n").to_numpy(zero_copy_only=False) if "_n" in batch.schema.names else np.ones(batch.num_rows, np.int64)
    keys = np.frombuffer(b"".join(batch.column("_key").to_pylist()), f"S{KEY}")
    return _Run(keys, ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column("_rid").to_numpy(zero_copy_only=False), counts)


def _runs(tree: _Tree, level: int, largest: bool):
    """Level 0 folds rows into a run; level r merges what round r - 1 has brought."""

    def run(batches):
        schema = pa.schema([("_dest", pa.int32()), ("_from", pa.int32()), ("_key", pa.binary()), ("_id", pa.int64()), ("_rid", pa.int64()), ("_n", pa.int64())])
        held: dict[int, list[_Run]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _entries(batch)
            if not level:
                held.setdefault(TaskContext.get().partitionId() % tree.size, []).append(_fold(rows, largest))
                continue
            # a sender's rows come in order; partitions can be read together
            dest, sender = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_dest", "_from"))
            edges = np.flatnonzero(np.concatenate([[True], (dest[1:] != dest[:-1]) | (sender[1:] != sender[:-1]) | (rows.keys[1:] <= rows.keys[:-1]), [True]]))
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                held.setdefault(int(dest[low]), []).append(rows.at(slice(low, high)))
        for holder, runs in held.items():
            own = _multiway(runs, largest)
            dest = tree.send(own.keys, holder, level) if level < tree.rounds else np.full(len(own.keys), holder, np.int64)
            raw = own.keys.tobytes()
            for at in range(0, len(own.keys), 50_000):
                part = slice(at, at + 50_000)
                blobs = [raw[i * KEY : (i + 1) * KEY] for i in range(at, min(at + 50_000, len(own.keys)))]
                yield textkit.output(schema, [dest[part].astype(np.int32), np.full(len(blobs), holder, np.int32), pa.array(blobs, pa.binary()), pa.array(own.ids[part], mask=own.missing[part]), own.rids[part], own.counts[part]])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256, text_length.

    keep: "largest" or "smallest" id of a group stays.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    staging, tree = Staging(spark, "exact"), _Tree(n)
    rows = docs.select(whole_id(docs, id_col).alias("_id"), F.monotonically_increasing_id().alias("_rid"), F.col(text_col).alias("_text"))
    digests = staging.put(rows.mapInArrow(_digest, _DIGESTS), "digests")
    runs = digests.mapInArrow(_runs(tree, 0, keep == "largest"), _RUN)
    for level in range(1, tree.rounds + 1):
        runs = runs.repartitionById(tree.size, "_dest").mapInArrow(_runs(tree, level, keep == "largest"), _RUN)
    groups = staging.put(runs.where("_n > 1").select(F.col("_key").alias("_group"), F.col("_id").alias("_keep"), F.col("_rid").alias("_keep_rid"), "_n"), "groups")
    joined = digests.join(groups, digests["_key"] == groups["_group"], "left")
    single: Column = F.col("_group").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(single, F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("_rid") == F.col("_keep_rid"))).alias("kept"),
        F.lower(F.hex(F.substring("_key", 1, 32))).alias("text_sha256"),
        F.conv(F.hex(F.substring("_key", 33, 8)), 16, 10).cast("long").alias("text_length"),
    )
