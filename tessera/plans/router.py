"""Which commands must run in order together.

Two keys belong together when a command, or a transaction, names both. Components come from the (command, key) edges of
multi-key commands; single-key commands need no edges. Commands that look at or change all keys have no component: the
fold runs them in every component and merges the answers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.components import smallest_reachable

#: Commands that look at or change all keys.
GLOBAL = ["FLUSHDB", "DBSIZE", "KEYS", "SCAN", "INFO", "MEMORY", "BGREWRITEAOF"]


def is_global() -> Column:
    """A command of all keys; MEMORY with a key is one of that key."""
    return F.upper("cmd").isin(GLOBAL) & (F.size("keys") == 0)


def with_keys(commands: DataFrame) -> DataFrame:
    """``commands`` with ``keys``, by the key rule of each command."""

    def run(batches):
        from tessera.plans import machine_admin, machine_sketch  # noqa: F401
        from tessera.plans.machine import keys_of

        for batch in batches:
            keys = [keys_of(cmd or "", args or []) for cmd, args in zip(batch.column("cmd").to_pylist(), batch.column("args").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.binary()))], names=[*batch.schema.names, "keys"])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in commands.schema.fields)
    return commands.mapInArrow(run, f"{old}, keys array<binary>")


def components(commands: DataFrame) -> DataFrame:
    """``commands`` (with keys) with ``component``: the smallest key that theirs are tied to; commands without keys are dealt over 256 components of their own, and global ones outside transactions have none."""
    block = F.col("tx_id") if "tx_id" in commands.columns else F.lit(None)
    unit = F.coalesce(F.concat(F.lit("t"), block.cast("string")), F.concat(F.lit("s"), F.col("seq").cast("string")))
    tagged = commands.withColumn("_unit", unit)
    edges = tagged.select("_unit", F.explode("keys").alias("_k")).distinct()
    star = edges.groupBy("_unit").agg(F.min("_k").alias("_a"), F.max("_k").alias("_z")).where("_a != _z").select("_unit", "_a")
    labels = smallest_reachable(edges.join(star, "_unit").select("_a", F.col("_k").alias("_b")))
    first = tagged.withColumn("_first", F.try_element_at("keys", F.lit(1)))
    own = first.groupBy("_unit").agg(F.min("_first").alias("_f")).join(labels, F.col("_f") == F.col("_k"), "left").select("_unit", F.coalesce("_l", "_f").alias("component"))
    alone = F.when(~is_global() | block.isNotNull(), F.concat(F.lit("\0").cast("binary"), F.pmod(F.xxhash64("_unit"), F.lit(256)).cast("string").cast("binary")))
    return tagged.join(own, "_unit").withColumn("component", F.coalesce("component", alone)).drop("_unit")
