"""Memory, eviction and metrics as DataFrames."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import glob_regex
from tessera.plans.ranking import distributed_rank


@dataclass
class EngineOptions:
    """Parameters of the engine; ``get`` takes a glob, ``set`` changes all or nothing."""

    maxmemory: int = 0
    maxmemory_policy: str = "noeviction"
    maxmemory_samples: int = 5
    lfu_log_factor: int = 10
    lfu_decay_time: int = 10_000
    slowlog_log_slower_than: int = 10_000
    slowlog_max_len: int = 128
    proto_max_bulk_len: int = 512 << 20
    appendfsync: str = "everysec"
    auto_rewrite_percentage: int = 100
    auto_rewrite_min_size: int = 64 << 20
    read_only: bool = False

    def get(self, pattern: str) -> dict[str, str]:
        match = glob_regex(pattern.replace("-", "_").encode()).match
        return {k.replace("_", "-"): str(v) for k, v in asdict(self).items() if match(k.encode())}

    def set(self, **changes: str) -> None:
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        parsed = {}
        for name, value in changes.items():
            if name not in kinds:
                raise ValueError(f"ERR Unknown option or number of arguments for CONFIG SET - '{name}'")
            try:
                parsed[name] = value in ("yes", "true", True) if kinds[name] is bool else kinds[name](value)
            except ValueError:
                raise ValueError(f"ERR CONFIG SET failed (possibly related to argument '{name}')") from None
        if parsed.get("maxmemory_policy", self.maxmemory_policy) not in POLICIES:
            raise ValueError("ERR CONFIG SET failed (possibly related to argument 'maxmemory_policy')")
        for name, value in parsed.items():
            setattr(self, name, value)


#: Ranks whose running total one task computes.
BLOCK = 100_000

POLICIES = ["noeviction", "allkeys-lru", "allkeys-lfu", "allkeys-random", "volatile-lru", "volatile-lfu", "volatile-random", "volatile-ttl"]


def entry_bytes(kind: Column, key: Column, size: Column, items: Column, expire: Column) -> Column:
    """Estimated bytes of a key. size: payload bytes; items: members, fields or elements (cells for sketches)."""
    k = F.octet_length(key)
    body = (
        F.when(kind == "string", F.lit(76) + size)
        .when(kind == "set", F.lit(196) + items * 60 + size)
        .when(kind == "zset", F.lit(740) + items * 135 + size)
        .when(kind == "hash", F.lit(164) + items * 64 + size)
        .when(kind == "list", F.lit(164) + items * 21 + size)
        .when(kind == "cms", F.lit(164) + items * 4)
        .when(kind == "morris", F.lit(164) + items)
        .when(kind == "hll", F.when(items <= 512, F.lit(164) + items * 4).otherwise(F.lit(100 + 1343 + 12289)))
        .otherwise(F.lit(164) + size)
    )
    return (body + k + F.when(expire.isNotNull(), 48).otherwise(0)).cast("long")


def memory_usage(state: DataFrame) -> DataFrame:
    """MEMORY USAGE of strings (key, type, value, expire_at_ms): with ``bytes``."""
    return state.withColumn("bytes", entry_bytes(F.col("type"), F.col("key"), F.octet_length("value"), F.lit(1), F.col("expire_at_ms")))


def memory_stats(sized: DataFrame) -> DataFrame:
    return sized.groupBy("type").agg(F.count(F.lit(1)).alias("keys"), F.sum("bytes").alias("bytes"))


def evict(sized: DataFrame, policy: str, maxmemory: int, seed: int = 0) -> DataFrame:
    """Rows that stay when the policy's victims go first until the rest fits: exact where samples would be approximate.

    Columns: key, bytes, expire_at_ms and, by policy, access (lru), frequency (lfu). The running total runs over
    range-sorted partitions, so no task holds all keys.
    """
    if policy == "noeviction":
        return sized
    scope, _, how = policy.partition("-")
    worth = {"lru": F.col("access"), "lfu": F.col("frequency"), "ttl": F.col("expire_at_ms"), "random": F.xxhash64("key", F.lit(seed))}[how].cast("long")
    fixed = sized.where(F.lit(False) if scope == "allkeys" else F.col("expire_at_ms").isNull())
    pool = sized if scope == "allkeys" else sized.where(F.col("expire_at_ms").isNotNull())
    pool = pool.withColumn("_worth", -worth).withColumn("_all", F.lit(0))
    held = fixed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_held"))
    kept = running_total(pool, ["_worth"], "key", "bytes")
    kept = kept.crossJoin(F.broadcast(held)).where(F.col("_used") + F.col("_held") <= maxmemory)  # one row
    return fixed.unionByName(kept.select(*sized.columns))


def running_total(df: DataFrame, order: list[str], tie: str, value: str) -> DataFrame:
    """``_used``: sum of ``value`` over this and all earlier rows; ties ascend by ``tie``.

    Ranks come from a range sort; blocks of ranks are summed one by one and behind each other.
    """
    placed = distributed_rank(df, ["_all"], [*order, tie], "_rank")
    ordered = placed.withColumn("_block", F.floor(F.col("_rank") / BLOCK))
    sums = ordered.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("_block").alias("_b"), before.alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ordered.withColumn("_in", inside).join(offsets, F.col("_block") == F.col("_b")).withColumn("_used", F.col("_in") + F.col("_before"))


def latency_histogram(calls: DataFrame) -> DataFrame:
    """(cmd, bucket, calls): calls up to each power-of-two bound in microseconds, cumulative over the buckets hit."""
    bucket = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("usec"), F.lit(1)).cast("double"))))).cast("long")
    counts = calls.groupBy("cmd", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select("cmd", "bucket", F.sum("_n").over(Window.partitionBy("cmd").orderBy("bucket")).alias("calls"))


def slowlog(calls: DataFrame, slower_than: int = 10_000, limit: int = 128) -> DataFrame:
    """Newest slow calls first: a top-k."""
    return calls.where(F.col("usec") >= slower_than).orderBy(F.col("id").desc()).limit(limit)


def command_stats(replies: DataFrame) -> DataFrame:
    """(cmd, calls, usec, rejected, failed) from replies with kind, error and usec."""
    refused = F.col("error").rlike("^ERR (unknown command|wrong number)|^OOM|^READONLY")
    return replies.groupBy("cmd").agg(F.count(F.when(~F.coalesce(refused, F.lit(False)), 1)).alias("calls"), F.sum("usec").alias("usec"), F.count(F.when(refused, 1)).alias("rejected"), F.count(F.when((F.col("kind") == "error") & ~refused, 1)).alias("failed"))


def info(sized: DataFrame, options: EngineOptions) -> DataFrame:
    """(section, field, value)."""
    facts = sized.agg(F.count(F.lit(1)).alias("keys"), F.count("expire_at_ms").alias("expires"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("used_memory"))
    rows = [("keyspace", "keys", F.col("keys")), ("keyspace", "expires", F.col("expires")), ("memory", "used_memory", F.col("used_memory"))]
    rows += [("memory", "maxmemory", F.lit(options.maxmemory)), ("memory", "maxmemory_policy", F.lit(options.maxmemory_policy))]
    made = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), v.cast("string").alias("value")) for s, f, v in rows])
    return facts.select(F.explode(made).alias("r")).select("r.*")


def command_catalog(spark: SparkSession) -> DataFrame:
    """COMMAND: name, arity, keys, writes, denyoom."""
    from tessera.plans import machine_admin, machine_sketch  # noqa: F401

    rows = [(c.name.lower(), c.arity, c.keys, c.writes, c.grows) for c in machine_sketch.COMMANDS.values()]
    return spark.createDataFrame(rows, "name string, arity int, keys string, writes boolean, denyoom boolean")


def lfu_frequency(touches: DataFrame, factor: int = 10, period: int = 10_000, seed: int = 0) -> DataFrame:
    """Logarithmic frequency of every key from its touches (key, clock): starts at 5, rises with a probability that falls as it rises, loses one for each ``period`` ticks without a touch.

    One task takes a key's touches in order and holds two numbers; the chance of a touch is a hash of key and clock, so
    reruns agree.
    """
    import pyarrow as pa

    from tessera.plans.machine import LFU_START

    rows = touches.select(F.col("key").cast("string").alias("key"), F.col("clock").cast("long").alias("clock"), (F.pmod(F.xxhash64("key", "clock", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)).alias("luck"))

    def run(batches):
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([f for _, f in found], pa.int64())], names=["key", "frequency"])

        now, frequency, last, found, begun = None, 0, 0, [], False
        for batch in batches:
            for key, clock, luck in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or key != now:
                    if begun:
                        found.append((now, frequency))
                    now, frequency, last, begun = key, LFU_START, clock, True
                frequency = max(0, frequency - (clock - last) // period) if period else frequency
                if frequency < 255 and luck * (max(0, frequency - LFU_START) * factor + 1) < 1:
                    frequency += 1
                last = clock
            if len(found) > 5000:
                yield out(found)
                found = []
        yield out([*found, (now, frequency)] if begun else found)

    return rows.repartition("key").sortWithinPartitions("key", "clock").mapInArrow(run, "key string, frequency long")
