"""Distributed ranks with one hot group."""

from pyspark.sql import functions as F

from tessera.plans.ranking import distributed_rank


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("score"), "id")
    found = distributed_rank(rows, ["key"], ["score", "id"]).toPandas()
    want = found.sort_values(["key", "score", "id"]).groupby("key").cumcount()
    assert (found["rank"].loc[want.index] == want).all() and len(found) == 5000


def test_empty_and_null_groups(spark):
    empty = spark.createDataFrame([], "key string, v long")
    assert distributed_rank(empty, ["key"], ["v"]).count() == 0
    nulls = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "key string, v long")
    assert sorted((r["key"] or "", r["v"], r["rank"]) for r in distributed_rank(nulls, ["key"], ["v"]).collect()) == [("", 1, 0), ("", 2, 1), ("a", 1, 0)]


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(500).select((F.col("id") * 7919 % 23 % 9).alias("a"), F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("b"), "id")
        found = distributed_rank(rows, ["a", "b"], ["id"]).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = found.sort_values("id").groupby(["a", "b"], dropna=False).cumcount()
    assert (found["rank"].loc[want.index] == want).all() and len(found) == 500


def test_spread_ranks_equal_windows(spark):
    from tessera.operators import zsets

    rows = spark.range(600).select(F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("key"), F.format_string("m%03d", "id").alias("member"), (F.col("id") * 7919 % 17).cast("double").alias("score"))
    shown = lambda df: sorted(map(tuple, df.select("key", "member", "rank").collect()))
    for reverse in (False, True):
        assert shown(zsets.zrank(rows, reverse)) == shown(zsets.zrank(rows, reverse, spread=True))
        every = zsets.zrank(rows, reverse).toPandas()
        n = every.groupby("key")["member"].transform("count")
        for start, end in ((-5, -2), (-300, -1), (2, -3), (-4, 900), (0, 3), (-1, -5)):
            low = (n + start).clip(lower=0) if start < 0 else start
            high = n + end if end < 0 else end
            want = every[(every["rank"] >= low) & (every["rank"] <= high)]
            assert shown(zsets.zrange(rows, start, end, reverse)) == sorted(map(tuple, want[["key", "member", "rank"]].itertuples(index=False))), (start, end)
