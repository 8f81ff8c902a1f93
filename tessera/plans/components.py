"""Connected components of an edge table by alternating large-star and small-star steps, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.stage import Stage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(_k, _l): every node of the edges (_a, _b) that has a smaller node in reach, with the smallest one."""
    stage = Stage(edges.sparkSession, "components")
    own = edges.select(F.greatest("_a", "_b").alias("_v"), F.least("_a", "_b").alias("_u")).where("_v != _u").distinct()
    own, last = stage.put(own), None
    while True:
        both = own.unionByName(own.select(F.col("_u").alias("_v"), F.col("_v").alias("_u")))
        least = both.groupBy(F.col("_v").alias("_k")).agg(F.min("_u").alias("_m")).select("_k", F.least("_k", "_m").alias("_m"))
        large = both.join(least, F.col("_v") == F.col("_k")).where("_u > _v").select(F.col("_u").alias("_v"), F.col("_m").alias("_u"))
        large = stage.put(large.where("_v != _u").distinct())
        least = large.groupBy(F.col("_v").alias("_k")).agg(F.min("_u").alias("_m"))
        small = large.join(least, F.col("_v") == F.col("_k"))
        small = small.select(F.when(F.col("_u") == F.col("_m"), F.col("_v")).otherwise(F.col("_u")).alias("_v"), F.col("_m").alias("_u"))
        own = stage.put(small.where("_v != _u").distinct())
        stage.drop()
        state = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_v", "_u").cast("decimal(38,0)"))).first()
        if state == last:
            return own.select(F.col("_v").alias("_k"), F.col("_u").alias("_l"))
        last = state
