"""Tables written to the folder that driver and executors share.

A written table cuts lineage: a lost executor costs a re-read, never a recomputation with other task boundaries.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset on one machine (tests), a folder of our own that is removed at exit; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Stage:
    """Written tables of one call; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, before: int | None = None) -> None:
        """Frees the tables up to number ``before`` (all but the last one by default)."""
        jvm = self.spark._jvm
        for i in range(1, self.count if before is None else before + 1):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{i}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
