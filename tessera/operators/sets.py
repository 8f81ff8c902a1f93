"""Sets. State: (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.state import remove

IDS = ["key", "member"]


def sadd(state: DataFrame, requests: DataFrame) -> DataFrame:
    return state.unionByName(requests.select(*IDS)).distinct()


def sadd_replies(state: DataFrame, requests: DataFrame) -> DataFrame:
    new = requests.select(*IDS).distinct().join(state, IDS, "left_anti")
    return new.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def srem(state: DataFrame, requests: DataFrame) -> DataFrame:
    return remove(state, requests, IDS)


def scard(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("members"))


def smismember(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state.select(*IDS, F.lit(1).alias("_e")), IDS, "left").withColumn("found", F.coalesce("_e", F.lit(0))).drop("_e")


def smembers(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.sort_array(F.collect_set("member")).alias("members"))


def srandmember(state: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n members of every key, picked by a hash of the member, so a rerun picks the same."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("member", F.lit(seed)), "member")
    return state.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def srandmember_repeats(state: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n draws with repeats of every key."""
    order = Window.partitionBy("key").orderBy("member")
    placed = state.withColumn("_i", F.row_number().over(order) - 1)
    draws = scard(state).select("key", "members", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    draws = draws.withColumn("_i", F.pmod(F.xxhash64("key", "draw", F.lit(seed)), F.col("members")).cast("int"))
    return draws.join(placed, ["key", "_i"]).select("key", "draw", "member")


def spop(state: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(popped, rest). The choice is a function of the rows, so popped and rest agree however often Spark runs them."""
    popped = srandmember(state, n, seed)
    return popped, remove(state, popped, IDS)


def sunion(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def sinter(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def sdiff(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
