"""Hashes. State: (key, field, value); changes: (seq, key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.state import first_write, last_write, remove, upsert

IDS = ["key", "field"]


def hset(state: DataFrame, changes: DataFrame) -> DataFrame:
    return upsert(state, last_write(changes, IDS, ["value"]), IDS)


def hset_replies(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, added): fields that were new."""
    new = changes.select(*IDS).distinct().join(state.select(*IDS), IDS, "left_anti")
    return new.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def hsetnx(state: DataFrame, changes: DataFrame) -> DataFrame:
    return state.unionByName(first_write(changes, IDS, ["value"]).join(state.select(*IDS), IDS, "left_anti"))


def hmget(requests: DataFrame, state: DataFrame) -> DataFrame:
    return requests.join(state, IDS, "left")


def hdel(state: DataFrame, requests: DataFrame) -> DataFrame:
    return remove(state, requests, IDS)


def hlen(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count(F.lit(1)).alias("fields"))


def hexists(requests: DataFrame, state: DataFrame) -> DataFrame:
    found = state.select(*IDS, F.lit(1).alias("_e"))
    return requests.join(found, IDS, "left").withColumn("found", F.coalesce("_e", F.lit(0))).drop("_e")


def hgetall(state: DataFrame) -> DataFrame:
    """(key, map): one map a key. A key with more fields than fit a row is read as rows."""
    return state.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("map"))


def hkeys(state: DataFrame) -> DataFrame:
    return hgetall(state).select("key", F.map_keys("map").alias("fields"))


def hvals(state: DataFrame) -> DataFrame:
    return hgetall(state).select("key", F.map_values("map").alias("values"))


def hincrby(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Final (key, field, value) of integer fields."""
    sums = changes.groupBy(*IDS).agg(F.sum("delta").alias("_d"))
    return state.join(sums, IDS, "full").select(*IDS, F.try_add(F.coalesce(F.col("value").cast("bigint"), F.lit(0).cast("bigint")), F.coalesce("_d", F.lit(0).cast("bigint"))).alias("value"))


def hincrby_running(changes: DataFrame) -> DataFrame:
    order = Window.partitionBy(*IDS).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return changes.withColumn("reply", F.sum("delta").over(order))
