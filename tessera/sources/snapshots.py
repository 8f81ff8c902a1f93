"""Versioned snapshots: a directory a version, and a chain of pointers.

Pointer n is a file ``pointers/n`` that is made once and never changed: its writer puts the whole text beside it and
renames it into place, which fails if another writer took n first. The current pointer is the highest one, so a crash
between two steps leaves the last whole version in force. A pointer carries a term; a writer that has seen a higher
term than its own may not publish (promotion and fencing).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fenced(RuntimeError):
    pass


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, term: int = 0):
        self.spark, self.root, self.term = spark, root.rstrip("/"), term
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def pointer(self) -> dict:
        """Facts of the current pointer; ``number`` is its place in the chain."""
        folder = self._path(f"{self.root}/pointers")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        if not number:
            return {"version": 0, "term": 0, "seq": -1, "number": 0}
        return json.loads(self._read(f"{self.root}/pointers/{number:012d}")) | {"number": number}

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def promote(self, term: int) -> None:
        """Take the term; it must be above every term that was published."""
        current = self.pointer()
        if term <= max(current["term"], self.term):
            raise Fenced(f"ERR term {term} is not above the current term {max(current['term'], self.term)}")
        self._publish(current | {"term": term}, current)
        self.term = term

    def _publish(self, facts: dict, current: dict) -> None:
        """The pointer after ``current``, by compare and set: it fails if another writer was faster."""
        number = current["number"] + 1
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        aside = self._path(f"{self.root}/pointers/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({k: v for k, v in facts.items() if k != "number"}).encode()))
        out.close()
        target = self._path(f"{self.root}/pointers/{number:012d}")
        taken = self._fs.exists(target)
        if taken or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Fenced(f"FENCED another writer published pointer {number}")

    def save(self, tables: dict[str, DataFrame], seq: int) -> int:
        """Write a new version that covers the log up to ``seq``."""
        current = self.pointer()
        if current["term"] > self.term:
            raise Fenced("FENCED this node is not the holder of the current term")
        version = current["version"] + 1
        # a folder of its own, so that two writers of one version do not mix
        folder = f"version={version}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{name}")
        self._publish({"version": version, "folder": folder, "term": self.term, "seq": seq, "tables": sorted(tables)}, current)
        return version

    def load(self) -> tuple[dict[str, DataFrame], int]:
        """Tables of the current version, and the last ``seq`` they cover."""
        p = self.pointer()
        return {t: self.spark.read.parquet(f"{self.root}/{p['folder']}/{t}") for t in p.get("tables", [])}, p["seq"]

    def tail(self, log: DataFrame) -> DataFrame:
        """Commands behind the snapshot; a gap between them is refused."""
        return self._after(log, self.pointer()["seq"])

    def pull(self, log: DataFrame, since: int = -1, term: int = 0) -> tuple[dict[str, DataFrame], DataFrame]:
        """What a replica that holds everything up to ``since`` still needs: the tables of the snapshot, none if it is past them, and the commands behind.

        A replica that names a term below the published one follows a writer that was replaced, and is refused.
        """
        current = self.pointer()
        if 0 < term < current["term"]:
            raise Fenced(f"FENCED term {term} is below the current term {current['term']}")
        if since >= current["seq"]:
            return {}, self._after(log, since)
        return self.load()[0], self._after(log, current["seq"])

    @staticmethod
    def _after(log: DataFrame, covered: int) -> DataFrame:
        rest = log.where(F.col("seq") > covered)
        facts = rest.agg(F.min("seq"), F.max("seq"), F.count_distinct("seq")).first()
        if facts[0] is not None and (facts[0] != covered + 1 or facts[1] - facts[0] + 1 != facts[2]):
            raise ValueError("ERR replication history gap")
        return rest
