"""Mixing sources to target weights.

Sources in code-point order (null last) weigh 1, 2, 3, repeating. A target is the weight's share of all words, at most
``cap`` times the source's own words; what exceeds a cap is shared again by weight among the sources below theirs.
Rows get a hash-random key; a range sort by (source, key) and prefix sums (inside a partition, then over the
partitions' totals) give each row the number of words before it in its source. A source gives whole epochs while they
fit, then is cut in the order of the keys at its exact budget: the row on the cut is taken in part.

Defined results: a null text has size 0; null is a source of its own; null ids are ordered by size; rows that agree in
every column are interchangeable; a source without words has target 0; a text of any length is counted whole; an empty
table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.staging import Staging, partitions, whole_id

WORD = r"[^\x20\x09-\x0D]+"


def _prefix(batches):
    """Words of the same source before each row, inside this partition; rows come sorted by source."""
    schema = pa.schema([("_id", pa.int64()), ("_source", pa.string()), ("_size", pa.int64()), ("_before", pa.int64())])
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(2).to_numpy(zero_copy_only=False)
        codes = batch.column(1).dictionary_encode()
        codes = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        base = -before[first]
        head = batch.column(1)[0].as_py()
        if total and head == last:
            base[0] += total
        before = before + np.repeat(base, np.diff(np.append(first, len(codes))))
        last, total = batch.column(1)[batch.num_rows - 1].as_py(), int(before[-1] + sizes[-1])
        yield textkit.output(schema, [batch.column(0), batch.column(1), sizes, before])


def targets(sizes: DataFrame, cap: int) -> DataFrame:
    """_source, _total, _target from rows (_source, _size); as many rows as there are sources."""
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    per = per.withColumn("_no", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())))
    per = per.withColumn("_weight", (F.col("_no") - 1) % 3 + 1).withColumn("_cap", F.col("_total") * cap)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_no")
    per = per.withColumn("_filled", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("_left", F.sum("_weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    per = per.withColumn("_all", F.sum("_total").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    level: Column = (F.col("_all") - F.coalesce("_filled", F.lit(0))).cast("double") / F.col("_left")
    per = per.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_weight"))
    first = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return per.select("_source", "_total", F.when(F.col("_open"), first * F.col("_weight")).otherwise(F.col("_cap").cast("double")).alias("_target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, seed: str = "mix") -> DataFrame:
    """One row per input row: ``id_col``, ``source_col``, size, source_size, target, taken."""
    spark = docs.sparkSession
    staging = Staging(spark, "mixing")
    rows = docs.select(
        whole_id(docs, id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(WORD)).cast("long").alias("_size"),
    ).withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null")))))
    rows = staging.put(rows, "sizes")
    per = staging.put(targets(rows, cap), "targets")
    order = ["_source", "_key", "_id", "_size"]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("_id", "_source", "_size")
    placed = staging.put(placed.mapInArrow(_prefix, "_id long, _source string, _size long, _before long").withColumn("_part", F.spark_partition_id()), "placed")
    parts = placed.groupBy("_source", "_part").agg(F.sum("_size").alias("_words"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    parts = parts.join(per.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), "_offset", "_total", "_target")
    parts = staging.put(parts, "parts")
    staging.drop("sizes", "targets")
    budget = F.floor(F.col("_target") + 0.5)
    epochs = F.when(F.col("_total") > 0, F.floor(budget / F.col("_total"))).otherwise(0)
    rest = budget - epochs * F.col("_total") - F.col("_offset") - F.col("_before")
    taken = epochs * F.col("_size") + F.greatest(F.lit(0), F.least(F.col("_size"), rest))
    joined = placed.join(parts, (F.col("_part") == F.col("_p")) & F.col("_source").eqNullSafe(F.col("_s")))
    return joined.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), taken.cast("long").alias("taken"))
