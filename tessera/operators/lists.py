"""Lists. State: (key, pos, value); positions are sparse and ordered, so a push at either end rewrites nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def indexed(state: DataFrame) -> DataFrame:
    """With ``idx`` from 0 and the list's length ``n``."""
    w = Window.partitionBy("key")
    return state.withColumn("idx", F.row_number().over(w.orderBy("pos")).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(w))


def push(state: DataFrame, changes: DataFrame, left: bool = False) -> DataFrame:
    """LPUSH and RPUSH of (seq, key, value): each value goes to the end in turn."""
    ends = state.groupBy("key").agg((F.min("pos") if left else F.max("pos")).alias("_end"))
    step = F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("long")
    rows = changes.withColumn("_i", step).join(ends, "key", "left")
    end = F.coalesce("_end", F.lit(0).cast("long"))
    return state.unionByName(rows.select("key", (end - F.col("_i") if left else end + F.col("_i")).alias("pos"), "value"))


def pushx(state: DataFrame, changes: DataFrame, left: bool = False) -> DataFrame:
    return push(state, changes.join(state.select("key").distinct(), "key", "left_semi"), left)


def _first(state: DataFrame, n: int, left: bool) -> DataFrame:
    """The n elements at one end of every key, with their place ``_r`` from 1: each task keeps n rows a key before the shuffle."""
    order = Window.partitionBy("key").orderBy(F.col("pos") if left else F.col("pos").desc())
    return state.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)


def pop(state: DataFrame, n: int, left: bool = True) -> tuple[DataFrame, DataFrame]:
    """(popped, rest) of every key."""
    popped = _first(state, n, left).drop("_r")
    if n <= 0:
        return popped, state
    ends = popped.groupBy(F.col("key").alias("_key")).agg((F.max("pos") if left else F.min("pos")).alias("_end"))
    behind = (F.col("pos") > F.col("_end")) if left else (F.col("pos") < F.col("_end"))
    return popped, state.join(ends, F.col("key").eqNullSafe(F.col("_key"))).where(behind).select(*state.columns)


def llen(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("length"))


def lindex(state: DataFrame, i: int) -> DataFrame:
    own = _first(state, i + 1 if i >= 0 else -i, i >= 0)
    return own.where(F.col("_r") == (i + 1 if i >= 0 else -i)).select("key", "value")


def lset(state: DataFrame, i: int, value: str) -> DataFrame:
    own = indexed(state)
    hit = F.col("idx") == (F.lit(i) if i >= 0 else F.col("n") + i)
    return own.select("key", "pos", F.when(hit, F.lit(value)).otherwise(F.col("value")).alias("value"))


def lrange(state: DataFrame, start: int, end: int) -> DataFrame:
    """Inclusive range of every key with ``idx``; LTRIM keeps the same rows."""
    own = indexed(state)
    low = F.greatest(F.lit(0).cast("long"), F.col("n") + start) if start < 0 else F.lit(start)
    high = F.col("n") + end if end < 0 else F.lit(end)
    return own.where((F.col("idx") >= low) & (F.col("idx") <= high)).drop("n")


def linsert(state: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """A value next to the first pivot of every key; positions are renumbered by two to make room."""
    own = indexed(state).select("key", (F.col("idx") * 2).alias("pos"), "value")
    spots = own.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("_p"))
    return own.unionByName(spots.select("key", (F.col("_p") + (1 if after else -1)).alias("pos"), F.lit(value).alias("value")))


def lrem(state: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first (count > 0), last (count < 0) or all (0) matches."""
    hit = F.col("value") == value
    if count == 0:
        return state.where(~hit)
    order = Window.partitionBy("key", "value").orderBy(F.col("pos") if count > 0 else F.col("pos").desc())
    return state.withColumn("_r", F.row_number().over(order)).where(~hit | (F.col("_r") > abs(count))).drop("_r")


def lpos(state: DataFrame, value: str, rank: int = 1, count: int | None = None, maxlen: int = 0) -> DataFrame:
    """(key, idx) of matches from the rank-th on, from the tail for a negative rank; count None is one, 0 is all."""
    own = indexed(state)
    if maxlen:
        own = own.where(F.col("idx") < maxlen if rank > 0 else F.col("idx") >= F.col("n") - maxlen)
    order = Window.partitionBy("key").orderBy(F.col("idx") if rank > 0 else F.col("idx").desc())
    found = own.where(F.col("value") == value).withColumn("_r", F.row_number().over(order)).where(F.col("_r") >= abs(rank))
    limit = 1 if count is None else count
    return (found.where(F.col("_r") < abs(rank) + limit) if limit else found).select("key", "idx")


def lmove(state: DataFrame, pairs: DataFrame, left: bool, to_left: bool, n: int = 1, keep_order: bool = False) -> DataFrame:
    """LMOVE, RPOPLPUSH and LMOVEM for (src, dst) pairs whose keys stand in one pair only: n elements from src to dst."""
    moved, _ = pop(state.join(pairs.select(F.col("src").alias("key")), "key", "left_semi"), n, left)
    rest = state.join(moved.select("key", "pos"), ["key", "pos"], "left_anti")
    forward = not to_left if keep_order else left
    seq = F.col("pos") if forward else -F.col("pos")
    changes = moved.join(pairs.withColumnRenamed("src", "key"), "key").select(seq.alias("seq"), F.col("dst").alias("key"), "value")
    return push(rest, changes, to_left)


def lmpop(requests: DataFrame, state: DataFrame, n: int, left: bool = True) -> DataFrame:
    """(req, key, value, pos): of each request's keys in order, n elements of the first that has any."""
    held = requests.join(state.select("key").distinct(), "key", "left_semi")
    first = held.groupBy("req").agg(F.min_by("key", "ord").alias("key"))
    popped, _ = pop(state, n, left)
    return first.join(popped, "key")
