"""Tables written to the folder that driver and executors share.

Operators cut lineage by writing a Parquet table below ``spark.checkpoint.dir`` and reading it again. A lost
executor then costs a re-read, never a recomputation with other task boundaries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tessera.plans.stage import shared_dir


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_id(df: DataFrame, name: str) -> Column:
    """Column ``name`` as long. Other types than whole numbers are refused, as a cast would turn them into null or into each other."""
    kind = df.select(F.col(name)).schema[0].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")
    return F.col(name).cast("long")


def lean(spark: SparkSession) -> None:
    """Lets Arrow batches hold 8 MB instead of Spark's 64 MB, unless the session names a size of its own: JVM and Python both hold a batch a task, some of it several times."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, str(8 << 20))


class Staging:
    """Tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        lean(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again."""
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Free tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
