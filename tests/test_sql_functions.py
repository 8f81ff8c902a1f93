"""Functions under their SQL names."""

from tessera.functions import sketches, sql


def test_registered_functions(spark, data):
    names = sql.register(spark)
    assert len(names) == len(set(names)) == 14
    spark.read.parquet(f"{data}/events.parquet").createOrReplaceTempView("events_of_sql")
    n = spark.sql("SELECT hll_estimate(hll_sketch(CAST(user_id AS STRING))) AS n FROM events_of_sql").first()["n"]
    assert abs(n / spark.sql("SELECT count(DISTINCT user_id) AS n FROM events_of_sql").first()["n"] - 1) < 0.03
    row = spark.sql("""
        WITH s AS (SELECT cms_sketch(event_type, CAST(1 AS BIGINT), 1000, 4) AS c, bloom_sketch(event_type, 100, CAST(0.01 AS DOUBLE)) AS b FROM events_of_sql)
        SELECT cms_estimate(c, 'absent') AS none, bloom_has(b, (SELECT min(event_type) FROM events_of_sql)) AS has, bloom_has(b, 'absent') AS hasnot, c,
               geo_score(13.361389, 38.115556) AS score, geo_hash(geo_score(13.361389, 38.115556)) AS hash, geo_dist(13.361389, 38.115556, 15.087269, 37.502669) AS dist,
               glob_match('hello', 'h[a-f]l*') AS glob, lcs_length('ohmytext', 'mynewtext') AS lcs, geo_score(0.0D, 89.0D) AS outside FROM s""").first()
    assert row["none"] == 0 and row["has"] and not row["hasnot"]
    assert row["score"] == 3479099956230698 and row["hash"] == "sqc8b49rny0" and abs(row["dist"] - 166274.15) < 1
    assert row["glob"] and row["lcs"] == 6 and row["outside"] is None
    total = spark.sql("SELECT count(*) AS n FROM events_of_sql").first()["n"]
    assert sketches.Cms.unpack(bytes(row["c"])).total == total


def test_merged_images(spark):
    sql.register(spark)
    n = spark.sql("SELECT hll_estimate(hll_merge(h)) AS n FROM (SELECT id % 7 AS k, hll_sketch(CAST(id % 3000 AS STRING)) AS h FROM range(9000) GROUP BY 1)").first()["n"]
    assert abs(n / 3000 - 1) < 0.03
