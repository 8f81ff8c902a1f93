"""Row numbers inside groups without one task a group.

A window puts a whole group into one task. Here rows are range-sorted by (group, order), so a hot group spreads over
many partitions; each partition numbers its rows, and the sizes of earlier partitions (one row a group and partition)
give the offsets.
"""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.stage import Stage


def _number(group: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        last, done, part = None, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            new = np.zeros(n, bool)
            for c in group:
                # equal neighbours have equal codes; nulls count as equal
                codes = pc.fill_null(pc.dictionary_encode(batch.column(c)).indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            head = tuple(batch.column(c)[0].as_py() for c in group)
            new[0] = head != last
            at = np.arange(n)
            place = at - np.maximum.accumulate(np.where(new, at, 0))
            if not new[0]:
                place[: int(np.argmax(new)) or n] += done
            done = int(place[-1]) + 1
            last = tuple(batch.column(c)[n - 1].as_py() for c in group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "_part", "_place"])

    return run


def distributed_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the 0-based place of each row in its group; ``order`` must tell rows apart or ties are in any order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = written(sorted_.mapInArrow(_number(group), f"{types}, _part int, _place long"))
    sizes = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"), before.alias("_o"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_place") + F.col("_o")).cast("long").alias(name))


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the folder that driver and executors share: the range bounds are then fixed."""
    return Stage(df.sparkSession, "ranked").put(df)
