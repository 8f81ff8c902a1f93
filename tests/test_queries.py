"""Every keyed query against its SQL on the smallest tables."""

import duckdb
import pytest

from conftest import DATA, compare
from tessera import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(name, spark, duck):
    found = queries.QUERIES[name](spark, DATA).toPandas()
    if name in queries.ORACLES:
        compare(found, duck.execute(queries.ORACLES[name]).df())
    else:
        assert len(found.columns)


def test_estimates_are_close(spark):
    found = queries.hll_pfcount(spark, DATA).toPandas()
    exact = queries._items(spark, DATA).groupBy("key").agg({"item": "count"}).toPandas()
    distinct = queries._items(spark, DATA).distinct().select("key", "item").distinct().groupBy("key").count().toPandas().set_index("key")["count"]
    assert len(found) == len(exact)
    for r in found.itertuples():
        assert abs(r.estimate / distinct[r.key] - 1) < 0.03


def test_logarithmic_frequencies(spark):
    from pyspark.sql import functions as F

    from tessera.operators import admin

    touches = spark.range(4000).select(F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("key"), F.col("id").alias("clock"))
    found = {r["key"]: r["frequency"] for r in admin.lfu_frequency(touches, factor=10, period=0).collect()}
    assert len(found) == 26 and found["hot"] > max(v for k, v in found.items() if k != "hot") and found["hot"] < 60
    decayed = {r["key"]: r["frequency"] for r in admin.lfu_frequency(touches, period=50).collect()}
    assert all(v <= 6 for k, v in decayed.items() if k != "hot")
    assert found == {r["key"]: r["frequency"] for r in admin.lfu_frequency(touches.repartition(3), factor=10, period=0).collect()}


def test_running_counts_order_ties_alike(spark):
    """Every item stands in one cell; rows of one seq come in the order that is asked for, wherever they lie."""
    from tessera.operators import sketches

    rows = spark.createDataFrame([("k", 1, f"{i:08d}", 1, i) for i in (3, 0, 2, 1)], "key string, seq long, item string, n long, place long")
    for own in (rows, rows.orderBy("item"), rows.orderBy(rows.item.desc())):
        found = sketches.cms_running(own.coalesce(1), 1, 4, ties=("place",))
        assert found.columns == ["key", "seq", "item", "n", "estimate"]
        assert sorted((r["item"], r["estimate"]) for r in found.collect()) == [(f"{i:08d}", i + 1) for i in range(4)]
