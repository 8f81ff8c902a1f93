"""Command logs through the interpreter, one group of tied keys a time.

Input: (seq, ts_ms, client, cmd, args) and, for transactions, tx_id. A group's commands run in order of ``seq`` in one
task; groups run side by side. Long histories of one key belong in the set-oriented operators, which fold before the
shuffle.

Commands over all keys (DBSIZE, KEYS, SCAN, FLUSHDB, INFO, MEMORY STATS, BGREWRITEAOF) run in every group, at their place
among the group's own commands; each group's share of the answer is merged by ``seq``. Up to ``GLOBALS`` of them travel
with the tasks. More are joined to the groups: a group that FLUSHDB has emptied meets none before its next own command,
so the log is cut into epochs at FLUSHDB, and a group takes those of the epochs in which it has commands.
"""

from __future__ import annotations

import json
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans import machine_admin, machine_sketch
from tessera.plans.machine import Machine, Reply, error, keys_of, ordered

REPLIES = "seq long, kind string, i long, s binary, d double, nested string, error string"
STATE = "component binary, key binary, type string, value binary, expire_at_ms long, records array<array<binary>>"
LOG = "component binary, place long, seq long, record array<binary>"


def plain(reply: Reply):
    """A reply as JSON-able values."""
    v = reply.value
    if reply.kind == "map":
        return {"map": [[plain(k), plain(x)] for k, x in v]}
    if reply.kind in ("array", "set"):
        return [plain(x) for x in v]
    if reply.kind == "error":
        return {"error": v}
    return v.decode("latin-1") if isinstance(v, bytes) else v


def row(seq: int, reply: Reply) -> tuple:
    k, v = reply
    return (seq, k, int(v) if k in ("int", "bool") else None, v if k in ("bulk", "status") else None, v if k == "double" else None, json.dumps(plain(reply)) if k in ("array", "set", "map") else None, v if k == "error" else None)


def _machine(seed: bytes) -> Machine:
    return Machine(seed=int.from_bytes(seed[:8].ljust(8, b"\0"), "big"))


#: Commands over all keys that travel with the tasks; more are joined to the groups.
GLOBALS = 1 << 16
#: Groups without keys over which the joined commands are dealt.
PIECES = 256
#: Commands that answer from, or act on, groups without keys too.
_UNQUIET = ("INFO", "BGREWRITEAOF")


class _Share:
    """What one group adds to the answer of a command over all keys."""

    def __init__(self, m: Machine, words: list[bytes], reply: Reply):
        name, self.parts = words[0].upper().decode("latin-1"), None
        if reply.kind == "error":
            return
        if name == "DBSIZE":
            self.parts = {"n": len(m.keys)}
        elif name in ("KEYS", "SCAN"):
            self.parts = {"keys": [(t, slot, k.decode("latin-1")) for t, slot, k in ordered(m)]}
        elif name == "INFO":
            self.parts = machine_admin.facts(m)
        elif name == "MEMORY":
            self.parts = {"map": [(k.value.decode(), x.value) for k, x in reply.value]} if reply.kind == "map" else None

    def json(self) -> str:
        return json.dumps(self.parts)


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """(seq, ts_ms, cmd, args, tx_id) of a frame of commands, in order of ``seq``."""
    frame = frame.sort_values("seq", kind="stable")
    blocks = frame["tx_id"] if "tx_id" in frame else [None] * len(frame)
    return [(s, ts, cmd, args, None if t is None or t != t else t) for s, ts, cmd, args, t in zip(frame["seq"], frame["ts_ms"], frame["cmd"], frame["args"], blocks, strict=True)]


class _Everywhere:
    """Commands over all keys in order, (place, seq, ts_ms, cmd, args, tx). quiet: those that a group without keys has no share in."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.places = rows, [x[:2] for x in rows]
        self.blocks = {x[5] for x in rows} - {None}
        self.quiet = not any(x[3].upper() in _UNQUIET for x in rows)

    def without(self, blocks: set) -> _Everywhere:
        return _Everywhere([x for x in self.rows if x[5] not in blocks]) if self.blocks & blocks else self


def _merged(own: list[tuple], found: _Everywhere, idle):
    """Own commands and those over all keys in the order of their places; where ``idle()``, the latter are passed over up to the next own one."""
    at, places, everywhere = 0, found.places, found.rows
    for x in [*own, None]:
        stop = len(everywhere) if x is None else bisect_left(places, x[:2], at)
        while at < stop and not idle():
            yield (*everywhere[at][:5], None, True)
            at += 1
        at = stop
        if x is not None:
            yield x


def _run(commands: list[tuple], m: Machine, everywhere: _Everywhere | None = None, shares: list | None = None, base: bool = True):
    """(seq, reply, records) of each command (seq, ts_ms, cmd, args, tx_id), blocks of a transaction together.

    everywhere: commands over all keys; those whose block is in the frame run there.
    Their shares go to ``shares`` as (seq, words, reply, share). A group without keys has no share in most of them, so
    only the base runs them all.
    """
    pending: list = []
    own = sorted(((seq, seq, ts, cmd, args, tx, False) for seq, ts, cmd, args, tx in commands), key=lambda x: x[0])
    everywhere = (everywhere or _Everywhere([])).without({x[5] for x in own} - {None})
    quiet = not base and everywhere.quiet
    last = {x[5]: x[1] for x in own}
    waiting: dict = {}

    def one(seq, words, reply, records):
        if words[0].upper() == b"BGREWRITEAOF" and reply.kind != "error":
            pending[:] = [(s, r, []) for s, r, _ in pending]
            records = list(m.log)
        pending.append((seq, reply, records))

    for _, seq, ts, cmd, args, tx, shared in _merged(own, everywhere, lambda: quiet and not m.keys):
        words = [cmd.encode(), *(bytes(x) for x in args)]
        m.now = int(ts)
        # keys take their places in the order of the whole log
        m.slots = max(m.slots, int(seq) << 10)
        start = len(m.log)
        if tx is None:
            reply = m.run(words)
            one(seq, words, reply, m.log[start:])
            if shared:
                shares.append((seq, words, reply, _Share(m, words, reply)))
            continue
        waiting.setdefault(tx, []).append((seq, words))
        if last[tx] == seq:
            refused = [m.refusal(w) for _, w in waiting[tx]]
            if any(refused):
                aborted = Reply("error", "EXECABORT Transaction discarded because of previous errors.")
                pending += [(s, r or aborted, []) for (s, _), r in zip(waiting[tx], refused, strict=True)]
            else:

                def seen(k, reply, block=waiting[tx]):
                    s, w = block[k]
                    if shares is not None and w[0].upper().decode("latin-1") in _EVERYWHERE and not keys_of(w[0].decode("latin-1"), w[1:]):
                        shares.append((s, w, reply, _Share(m, w, reply)))

                answers = m.block([w for _, w in waiting[tx]], seen).value
                pending += [(s, r, m.log[start:] if s == seq else []) for (s, _), r in zip(waiting[tx], answers, strict=True)]
    return pending


def _answer(words: list[bytes], base: Reply, parts: list[dict]) -> Reply:
    """The answer of a command over all keys from the shares of all groups."""
    name = words[0].upper().decode("latin-1")
    if base.kind == "error" or not parts:
        return base
    if name == "DBSIZE":
        return Reply("int", sum(p["n"] for p in parts))
    if name in ("KEYS", "SCAN"):
        m = machine_sketch.catalogue((t, slot, k.encode("latin-1")) for p in parts for t, slot, k in p["keys"])
        return m.run(words)
    if name == "INFO":
        return machine_admin.info(machine_admin.added(parts), words[1:])
    totals: dict[str, int] = {}
    for p in parts:
        for k, n in p["map"]:
            totals[k] = totals.get(k, 0) + n
    return Reply("map", [(Reply("bulk", k.encode()), Reply("int", n)) for k, n in totals.items()])


_EVERYWHERE = ("FLUSHDB", "DBSIZE", "KEYS", "SCAN", "INFO", "MEMORY", "BGREWRITEAOF")
_SHARES = "share string, words array<binary>"


def _everywhere(commands: DataFrame) -> DataFrame:
    """Commands over all keys, (place, seq, ts_ms, cmd, args, tx_id), at the place of their transaction's last command."""
    from tessera.plans import router

    found = commands.where(router.is_global())
    if "tx_id" not in commands.columns:
        return found.select(F.col("seq").alias("place"), "seq", "ts_ms", "cmd", "args", F.lit(None).cast("long").alias("tx_id"))
    return _placed(found, commands).select("place", "seq", "ts_ms", "cmd", "args", "tx_id")


def _placed(rows: DataFrame, commands: DataFrame) -> DataFrame:
    """``rows`` with their place: the last ``seq`` of their transaction, else their own."""
    ends = commands.where("tx_id is not null").groupBy(F.col("tx_id").alias("_t")).agg(F.max("seq").alias("_end"))
    return rows.join(ends, F.col("tx_id") == F.col("_t"), "left").withColumn("place", F.coalesce("_end", "seq")).drop("_t", "_end")


def _collected(found: DataFrame) -> list[tuple]:
    return sorted((r["place"], r["seq"], r["ts_ms"], r["cmd"], [bytes(x) for x in r["args"]], r["tx_id"]) for r in found.collect())


def _epochs(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_epoch``, the FLUSHDB commands placed before each: counted in ranges of places, whose totals are summed."""
    emptied = (F.upper("cmd") == "FLUSHDB") & (F.size("args") == 0) & F.col("tx_id").isNull()
    marked = rows.withColumn("_f", F.coalesce(F.col("_shared") & emptied, F.lit(False)).cast("int"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)

    def count(batches):
        before, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            f = batch.column("_f").to_numpy()
            total = before + np.cumsum(f, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(f), part, np.int32)), pa.array(total - f)], names=[*batch.schema.names, "_part", "_before"])
            before = int(total[-1]) if len(f) else before

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = _written(marked.repartitionByRange(n, "place").sortWithinPartitions("place", "seq").mapInArrow(count, f"{types}, _part int, _before long"))
    sizes = counted.groupBy("_part").agg(F.sum("_f").alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_part").alias("_p"), earlier.alias("_o"))
    return counted.join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("_epoch", F.col("_before") + F.col("_o")).drop("_f", "_part", "_p", "_o", "_before")


def _dealt(own: DataFrame, found: DataFrame, outputs: str) -> DataFrame:
    """Own commands, and for every group those over all keys that it can have a share in, with their place; those of the groups without keys have a piece too."""
    columns = ["component", "seq", "ts_ms", "cmd", "args", "tx_id", "place", "piece"]
    quiet = found.where(F.upper("cmd").isin(*_UNQUIET)).isEmpty()
    blank = F.lit(None).cast("long")
    if "tx_id" not in own.columns:
        own = own.withColumn("tx_id", blank).withColumn("place", F.col("seq"))
    else:
        own = _placed(own, own)
    own = own.select("component", "seq", "ts_ms", "cmd", "args", "tx_id", "place", F.lit(False).alias("_shared"))
    both = own.unionByName(found.select(F.lit(None).cast("binary").alias("component"), *found.columns, F.lit(True).alias("_shared")))
    if quiet:
        both = _epochs(both)
        groups = both.where("not _shared").groupBy("component", "_epoch").agg(F.min("place").alias("_first"))
        shared = both.where("_shared").drop("component")
        met = shared.join(groups, "_epoch").where("place > _first")
    else:
        both = _written(both)
        shared = both.where("_shared").drop("component")
        met = shared.crossJoin(both.where("not _shared").select("component").distinct())
    # without INFO and a log the machine of a group without keys is always empty, so its commands need not run together
    piece = F.pmod(F.xxhash64("seq"), F.lit(PIECES)) if quiet and outputs == "replies" else F.lit(0)
    mine = both.where("not _shared").withColumn("place", blank).withColumn("piece", blank)
    alone = shared.withColumn("component", F.lit(None).cast("binary")).withColumn("piece", piece.cast("long"))
    return mine.select(columns).unionByName(met.withColumn("piece", blank).select(columns)).unionByName(alone.select(columns))


def run(commands: DataFrame, outputs: str = "replies", routed: bool = False) -> DataFrame:
    """outputs: "replies", "log" (canonical records) or "state" (what the log leaves). routed: ``keys`` and ``component`` are there already."""
    from tessera.plans import router

    if not routed:
        keyed = router.with_keys(commands)
        commands = router.components(keyed) if "tx_id" in commands.columns else _by_first_key(keyed)
    found = _everywhere(commands)
    few = _collected(found.limit(GLOBALS + 1))
    anywhere, many = bool(few), len(few) > GLOBALS
    everywhere = _Everywhere([] if many else few)
    if anywhere:
        # a group without keys of its own answers where there are no keys, and names errors
        commands = commands.where(~router.is_global() | (F.col("tx_id").isNotNull() if "tx_id" in commands.columns else F.lit(False)))
    if many:
        commands = _dealt(commands, found, outputs)
    elif anywhere:
        empty = commands.sparkSession.createDataFrame([(None,)], "component binary")
        commands = commands.unionByName(empty, allowMissingColumns=True)
    schema = {"replies": f"{REPLIES}, {_SHARES}", "state": STATE, "log": LOG}[outputs]

    def step(key, commands):
        name = key or b""
        m, shares = _machine(name), []
        shared = _Everywhere(sorted((place, *command[:5]) for *command, place in commands if place is not None)) if many else everywhere
        done = _run([command[:5] for command in commands if command[5] is None], m, shared, shares, key is None)
        if outputs == "replies":
            shared = {s for s, *_ in shares}
            rows = [(*row(s, r), None, None) for s, r, _ in done if s not in shared]
            return rows + [(*row(s, reply), share.json(), words) for s, words, reply, share in shares if key is None or share.parts and any(share.parts.values())]
        if outputs == "log":
            return [(name, i, s, x) for i, (s, x) in enumerate((s, x) for s, _, records in done for x in records)]
        records = {}
        for x in machine_sketch.rewrite(m):
            records.setdefault(x[1], []).append(x)
        return [(name, k, m.keys[k].type, m.keys[k].value if m.keys[k].type == "string" else machine_sketch.dump(m.keys[k].type, m.keys[k].value), m.keys[k].expire, records[k]) for _, _, k in ordered(m)]

    def merge(seq, answers):
        words, errors = answers[0][2], [e for e, _, _ in answers if e]
        parts = [p for p in (json.loads(share) for _, share, _ in answers) if p]
        if errors:
            return [row(seq, error(errors[0]))]
        return [row(seq, _answer(words, Reply("int", 0), parts) if parts else _machine(b"").run(words))]

    found = _each_component(commands, step, schema)
    if outputs != "replies":
        return found
    if not anywhere:
        return found.drop("share", "words")
    found = _written(found)
    shares = found.where("words is not null").select("seq", "error", "share", "words").repartition("seq").sortWithinPartitions("seq")
    return found.where("words is null").drop("share", "words").unionByName(_by_group(shares, merge, REPLIES, 1))


def _written(df: DataFrame) -> DataFrame:
    from tessera.plans.ranking import written

    return written(df)


def _by_first_key(keyed: DataFrame) -> DataFrame:
    """Components; the label rounds are skipped where no command names two keys."""
    from tessera.plans import router

    if keyed.where(F.size("keys") > 1).isEmpty():
        alone = F.when(~router.is_global(), F.concat(F.lit("\0").cast("binary"), F.pmod(F.xxhash64("seq"), F.lit(256)).cast("string").cast("binary")))
        return keyed.withColumn("component", F.coalesce(F.try_element_at("keys", F.lit(1)), alone))
    return router.components(keyed)


_TYPES = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<array<binary>>": pa.list_(pa.list_(pa.binary()))}


def _each_component(commands: DataFrame, step, schema: str) -> DataFrame:
    """``step(component, commands)`` gives the rows of each component, which come together in order of ``seq``. A task holds one component's commands at a time."""
    block, places = (F.col(c).cast("long") if c in commands.columns else F.lit(None).cast("long") for c in ("tx_id", "place"))
    piece = F.col("piece") if "piece" in commands.columns else F.lit(None).cast("long")
    rows = commands.select("component", piece.alias("piece"), F.col("seq").cast("long").alias("seq"), F.col("ts_ms").cast("long").alias("ts_ms"), "cmd", "args", block.alias("tx_id"), places.alias("place"))
    own = lambda key, held: step(key, [x for x in held if x[0] is not None])
    return _by_group(rows.repartition("component", "piece").sortWithinPartitions("component", "piece", "seq"), own, schema, 2)


def _by_group(rows: DataFrame, step, schema: str, width: int) -> DataFrame:
    """``step(key, rows)`` gives the rows of each group; ``rows`` come sorted by their first ``width`` columns, which tell groups apart, and the first is the key."""
    names, kinds = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)

    def run(batches):
        def done(key, held, out):
            out += step(key[0], held)
            if len(out) >= 5000:
                yield batch_of(out)
                out.clear()

        def batch_of(out):
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[k]) for c, k in zip(columns, kinds, strict=True)], names=list(names))

        now, held, out = None, [], []
        for batch in batches:
            for command in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, command = command[:width], command[width:]
                if now is not None and key != now:
                    yield from done(now, held, out)
                    held = []
                now = key
                held.append(command)
        if now is not None:
            yield from done(now, held, out)
        yield batch_of(out)

    return rows.mapInArrow(run, schema)


def replay(log: DataFrame) -> DataFrame:
    """State that a log of (component, place, record) leaves."""
    rows = log.select("component", F.col("place").alias("seq"), F.lit(0).alias("ts_ms"), F.lit("").alias("cmd"), F.col("record").alias("args"))

    def step(key, commands):
        m = _machine(key or b"")
        m.replay([args for _, _, _, args, *_ in commands])
        return [(k, m.keys[k].type, machine_sketch.dump(m.keys[k].type, m.keys[k].value), m.keys[k].expire) for _, _, k in ordered(m)]

    return _each_component(rows, step, "key binary, type string, image binary, expire_at_ms long")
