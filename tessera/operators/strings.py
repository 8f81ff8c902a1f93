"""Strings and counters. State: (key, value); changes: (seq, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.state import first_write, last_write, upsert


def set_(state: DataFrame, changes: DataFrame) -> DataFrame:
    """SET and MSET: the last write of each key wins."""
    return upsert(state, last_write(changes, ["key"], ["value"]), ["key"])


def setnx(state: DataFrame, changes: DataFrame) -> DataFrame:
    """SETNX: the first write of each key wins where the key was missing."""
    new = first_write(changes, ["key"], ["value"]).join(state.select("key"), "key", "left_anti")
    return state.unionByName(new)


def msetnx(state: DataFrame, changes: DataFrame) -> DataFrame:
    """MSETNX by ``tx``: a block is applied when none of its keys exists; blocks name different keys."""
    refused = changes.join(state.select("key"), "key", "left_semi").select("tx").distinct()
    return set_(state, changes.join(refused, "tx", "left_anti"))


def mget(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state, "key", "left")


def getset(changes: DataFrame) -> DataFrame:
    """GETSET: every write with the value before it."""
    return changes.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def append(state: DataFrame, changes: DataFrame) -> DataFrame:
    """APPEND: the parts in order behind the old value."""
    parts = changes.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), "").alias("_tail"))
    joined = state.join(parts, "key", "full")
    return joined.select("key", F.concat(F.coalesce("value", F.lit("")), F.coalesce("_tail", F.lit(""))).alias("value"))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int, end: int) -> Column:
    """Inclusive byte range; negative places count from the end."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    place = lambda i: F.greatest(F.lit(0), n + i) if i < 0 else F.lit(i)
    low, high = place(start), F.least(place(end), n - 1)
    empty = F.lit(start < 0 and end < 0 and start > end) | (n == 0) | (low > high)
    return F.when(empty, F.lit(b"")).otherwise(F.substring(raw, low + 1, high - low + 1))


def setrange(value: Column, at: int, part: bytes) -> Column:
    """Overwrite at a byte offset, padded with zero bytes."""
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    if not part:
        return raw
    padded = F.when(F.octet_length(raw) < at, F.rpad(raw, F.lit(at), F.lit(b"\0"))).otherwise(raw)
    return F.overlay(padded, F.lit(part), F.lit(at + 1))


def incr(state: DataFrame, changes: DataFrame) -> DataFrame:
    """INCRBY in bulk: final (key, value, overflow); the sum is exact in 38 digits."""
    sums = changes.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("_d"))
    total = F.coalesce(F.col("value").cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) + F.coalesce("_d", F.lit(0).cast("decimal(38,0)"))
    out = state.join(sums, "key", "full").select("key", total.alias("_t"))
    return out.select("key", F.col("_t").try_cast("bigint").alias("value"), F.col("_t").try_cast("bigint").isNull().alias("overflow"))


def incr_running(changes: DataFrame) -> DataFrame:
    """The reply of every INCRBY."""
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("reply", F.sum("delta").over(order))


def setex(state: DataFrame, changes: DataFrame) -> DataFrame:
    """SETEX and PSETEX on (key, value, expire_at_ms): the last write (seq, key, value, ttl_ms, ts_ms) of each key, with its own time to live; null keeps none."""
    rows = changes.withColumn("expire_at_ms", F.col("ts_ms") + F.col("ttl_ms"))
    return upsert(state, last_write(rows, ["key"], ["value", "expire_at_ms"]), ["key"])


def set_options(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET with NX or XX and GET: (seq, key, value, option) -> replies (seq, key, applied, old) and the state.

    A key is there once a write without XX has come, or if it was there before, so one window decides every option.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    option = F.upper(F.coalesce("option", F.lit("")))
    rows = changes.join(state.select("key", F.col("value").alias("_held"), F.lit(True).alias("_was")), "key", "left")
    there = F.coalesce("_was", F.lit(False)) | F.coalesce(F.max(option != "XX").over(before), F.lit(False))
    rows = rows.withColumn("applied", F.when(option == "NX", ~there).when(option == "XX", there).otherwise(F.lit(True)))
    rows = rows.withColumn("old", F.coalesce(F.last(F.when(F.col("applied"), F.col("value")), ignorenulls=True).over(before), F.col("_held")))
    return rows.select("seq", "key", "applied", "old"), set_(state, rows.where("applied").select("seq", "key", "value"))


def getdel(requests: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETDEL: (seq, key) -> replies (seq, key, value), the value for the first request of a key, and the state without the keys."""
    first = requests.groupBy("key").agg(F.min("seq").alias("_first"))
    rows = requests.join(first, "key").join(state.select("key", "value"), "key", "left")
    return rows.select("seq", "key", F.when(F.col("seq") == F.col("_first"), F.col("value")).alias("value")), state.join(first, "key", "left_anti")


def getex(requests: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GETEX: (seq, key, expire_at_ms) -> replies (seq, key, value), and (key, value, expire_at_ms) with the last time to live that was asked for; null persists."""
    replies = requests.select("seq", "key").join(state.select("key", "value"), "key", "left")
    last = last_write(requests, ["key"], ["expire_at_ms"]).withColumnRenamed("expire_at_ms", "_new").withColumn("_asked", F.lit(True))
    kept = state.join(last, "key", "left").withColumn("expire_at_ms", F.when(F.col("_asked"), F.col("_new")).otherwise(F.col("expire_at_ms")))
    return replies.select("seq", "key", "value"), kept.select(*state.columns)


def incrbyfloat(state: DataFrame, changes: DataFrame) -> DataFrame:
    """INCRBYFLOAT in bulk on decimal text: final (key, value), exact to 17 places after the point."""
    exact = "decimal(38,17)"
    sums = changes.groupBy("key").agg(F.sum(F.col("delta").cast(exact)).alias("_d"))
    zero = F.lit(0).cast(exact)
    out = state.join(sums, "key", "full").select("key", (F.coalesce(F.col("value").cast(exact), zero) + F.coalesce("_d", zero)).cast(exact).cast("string").alias("_t"))
    return out.select("key", F.regexp_replace(F.regexp_replace("_t", r"(\.\d*?)0+$", "$1"), r"\.$", "").alias("value"))
