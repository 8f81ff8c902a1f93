"""Sorted sets. State: (key, member, score); order by score, then member bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.state import first_write, last_write, remove, upsert
from tessera.plans.ranking import distributed_rank

IDS = ["key", "member"]


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def zadd(state: DataFrame, changes: DataFrame, mode: str = "") -> DataFrame:
    """ZADD of (seq, key, member, score): last write wins; NX adds only, XX updates only."""
    if mode == "NX":
        return state.unionByName(first_write(changes, IDS, ["score"]).join(state.select(*IDS), IDS, "left_anti"))
    rows = last_write(changes, IDS, ["score"])
    return upsert(state, rows.join(state.select(*IDS), IDS, "left_semi") if mode == "XX" else rows, IDS)


def zincrby(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Sums of deltas; exact for integer scores, in any order."""
    sums = changes.groupBy(*IDS).agg(F.sum("delta").alias("_d"))
    return state.join(sums, IDS, "full").select(*IDS, (F.coalesce("score", F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))).alias("score"))


def _sizes(state: DataFrame) -> DataFrame:
    """(_key, _n): members of each key; a partial aggregate, so a hot key sends one row a task."""
    return state.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"))


def zrank(state: DataFrame, reverse: bool = False, spread: bool = False) -> DataFrame:
    """Rank of every member. A window holds a key in one task; with ``spread`` the members are range-sorted instead, so that a hot key spreads over all tasks."""
    if not spread:
        return state.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))).cast("long") - 1)
    ranked = distributed_rank(state, ["key"], ["score", "member"])
    if not reverse:
        return ranked
    # the reverse order reverses ties too, so places mirror
    return ranked.join(_sizes(state), F.col("key").eqNullSafe(F.col("_key"))).withColumn("rank", F.col("_n") - 1 - F.col("rank")).drop("_key", "_n")


def _first(state: DataFrame, n: int, reverse: bool) -> DataFrame:
    """The first n members of every key, with their place ``_r`` from 1: each task keeps n rows a key before the shuffle."""
    return state.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse)))).where(F.col("_r") <= n)


def zrange(state: DataFrame, start: int, end: int, reverse: bool = False, spread: bool = False) -> DataFrame:
    """Inclusive range of ranks of every key. From either end it is a top-k; a range that leaves something out at both ends ranks all members."""
    if start >= 0 and end >= 0:
        return _first(state, end + 1, reverse).withColumn("rank", F.col("_r").cast("long") - 1).where(F.col("rank") >= start).drop("_r")
    sizes = _sizes(state)
    same = F.col("key").eqNullSafe(F.col("_key"))
    if start < 0 and end < 0:
        own = _first(state, -start, not reverse).where(F.col("_r") >= -end).join(sizes, same)
        return own.withColumn("rank", F.col("_n") - F.col("_r")).drop("_r", "_n", "_key")
    own = zrank(state, reverse, spread).join(sizes, same)
    low = F.greatest(F.lit(0).cast("long"), F.col("_n") + start) if start < 0 else F.lit(start)
    return own.where((F.col("rank") >= low) & (F.col("rank") <= (F.col("_n") + end if end < 0 else F.lit(end)))).drop("_n", "_key")


def in_score(low: float, high: float, open_low: bool = False, open_high: bool = False) -> Column:
    s = F.col("score")
    return ((s > low) if open_low else (s >= low)) & ((s < high) if open_high else (s <= high))


def zrange_by_score(state: DataFrame, low: float, high: float, open_low: bool = False, open_high: bool = False, reverse: bool = False, offset: int = 0, count: int = -1, spread: bool = False) -> DataFrame:
    """The predicate reaches the scan; with a count it is a top-k. A negative offset gives nothing, a negative count all."""
    inside = state.where(in_score(low, high, open_low, open_high))
    if offset >= 0 and count >= 0:
        return _first(inside, offset + count, reverse).withColumn("place", F.col("_r").cast("long") - 1).where(F.col("place") >= offset).drop("_r")
    own = zrank(inside, reverse, spread).withColumnRenamed("rank", "place")
    return own.where(F.col("place") >= offset) if offset >= 0 else own.where(F.lit(False))


def zcount(state: DataFrame, low: float, high: float, open_low: bool = False, open_high: bool = False) -> DataFrame:
    return state.where(in_score(low, high, open_low, open_high)).groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def zcard(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def zscore(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state, IDS, "left")


def zrem(state: DataFrame, requests: DataFrame) -> DataFrame:
    return remove(state, requests, IDS)


def zpop(state: DataFrame, n: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, rest)."""
    popped = zrange(state, 0, n - 1, highest)
    return popped, remove(state, popped, IDS)
