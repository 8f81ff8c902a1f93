"""Operators on pairs of values."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions import text
from tessera.functions.hashing import as_bytes


def lcs(df: DataFrame, a: str, b: str, min_length: int = 0) -> DataFrame:
    """LCS of two string columns: length, subsequence, and runs of at least ``min_length`` as "a,b,n" from the end."""

    def run(batches):
        for batch in batches:
            found = [text.lcs(x, y) for x, y in zip(as_bytes(batch.column(a).to_pylist()), as_bytes(batch.column(b).to_pylist()), strict=True)]
            columns = [pa.array([len(s) for s, _ in found], pa.int64()), pa.array([s.decode("utf-8", "replace") for s, _ in found]), pa.array([[f"{p},{q},{n}" for p, q, n in runs if n >= min_length] for _, runs in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "length", "subsequence", "runs"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{old}, length long, subsequence string, runs array<string>")
