"""Sketches as rows: hashing runs in Arrow batches, everything that merges is a Spark aggregate.

HyperLogLog rows are (key, reg, rank), Count-Min cells (key, row, col, cnt), Bloom bits (key, bit). All three merge by
an associative aggregate, so a hot key is folded in every task before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import sketches as kernels
from tessera.functions.hashing import as_bytes


def _mapped(df: DataFrame, schema: str, make) -> DataFrame:
    """``make(batch)`` gives arrays for the new columns behind those of ``df``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                names, columns = zip(*make(batch).items(), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{old}, {schema}")


# ---- HyperLogLog


def hll_places(df: DataFrame, item: str = "item") -> DataFrame:
    def make(batch):
        reg, rank = kernels.Hll.places(as_bytes(batch.column(item).to_pylist()))
        return {"reg": pa.array(reg, pa.int32()), "rank": pa.array(rank, pa.int32())}

    return _mapped(df, "reg int, rank int", make)


def hll_registers(df: DataFrame, item: str = "item") -> DataFrame:
    """PFADD in bulk: registers of every key."""
    return hll_places(df, item).groupBy("key", "reg").agg(F.max("rank").alias("rank"))


def hll_merge(registers: DataFrame, into: Column) -> DataFrame:
    """PFMERGE: union of the sketches that share a destination."""
    return registers.groupBy(into.alias("key"), "reg").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame) -> DataFrame:
    """PFCOUNT of every key, from its histogram of ranks (at most 52 rows a key)."""
    histogram = registers.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("_n"))
    lists = histogram.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "_n"))).alias("_h"))

    def make(batch):
        out = []
        for pairs in batch.column("_h").to_pylist():
            h = np.zeros(kernels.Hll.Q + 2, np.int64)
            for rank, n in pairs:
                h[rank] = n
            h[0] = kernels.Hll.REGISTERS - h.sum()
            out.append(kernels.estimate(h))
        return {"estimate": pa.array(out, pa.int64())}

    return _mapped(lists, "estimate long", make).drop("_h")


def hll_changed(df: DataFrame, item: str = "item") -> DataFrame:
    """Reply of every PFADD of one item (seq, key, item): whether its register rose."""
    before = Window.partitionBy("key", "reg").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("key").orderBy("seq")
    rose = (F.col("rank") > F.coalesce(F.max("rank").over(before), F.lit(0))) | (F.row_number().over(first) == 1)
    return hll_places(df, item).withColumn("changed", rose.cast("int"))


# ---- Count-Min


def cms_places(df: DataFrame, width: int, depth: int, item: str = "item") -> DataFrame:
    """A row for each sketch row: (…, row, col)."""

    def make(batch):
        at = kernels.cells(as_bytes(batch.column(item).to_pylist()), width, depth)
        flat = np.ascontiguousarray(at.T.astype(np.int32)).ravel()
        ends = np.arange(0, len(flat) + 1, depth, dtype=np.int32)
        return {"_cols": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    placed = _mapped(df, "_cols array<int>", make)
    return placed.select(*df.columns, F.posexplode("_cols").alias("row", "col"))


def cms_cells(df: DataFrame, width: int, depth: int, item: str = "item", count: str = "n") -> DataFrame:
    """CMS.INCRBY in bulk: saturated cells of every key; repeated items are folded before they are spread over rows."""
    folded = df.groupBy("key", item).agg(F.sum(F.col(count)).alias("_n"))
    cells = cms_places(folded, width, depth, item).groupBy("key", "row", "col")
    return cells.agg(F.least(F.sum("_n"), F.lit(kernels.U32)).alias("cnt"))


def cms_query(cells: DataFrame, requests: DataFrame, width: int, depth: int, item: str = "item") -> DataFrame:
    """Smallest cell of each request (key, item); a cell that no item has touched is 0."""
    asked = cms_places(requests, width, depth, item).join(cells, ["key", "row", "col"], "left")
    return asked.groupBy(*requests.columns).agg(F.min(F.coalesce("cnt", F.lit(0))).alias("estimate"))


def cms_merge(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """CMS.MERGE: (src, dst, weight) rows; ``valid`` is false where a cell leaves its range."""
    joined = cells.join(weights.withColumnRenamed("src", "key"), "key")
    total = joined.groupBy(F.col("dst").alias("key"), "row", "col").agg(F.sum(F.col("cnt").cast("decimal(38,0)") * F.col("weight")).alias("cnt"))
    return total.withColumn("valid", (F.col("cnt") >= 0) & (F.col("cnt") <= kernels.U32)).withColumn("cnt", F.col("cnt").try_cast("bigint"))


def cms_running(df: DataFrame, width: int, depth: int, item: str = "item", count: str = "n", ties: tuple[str, ...] = ()) -> DataFrame:
    """Reply of every CMS.INCRBY (seq, key, item, n): the estimate behind it. ties: columns that order rows of one ``seq``, alike in all rows of the sketch; they are dropped."""
    placed = cms_places(df, width, depth, item)
    order = Window.partitionBy("key", "row", "col").orderBy("seq", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = placed.withColumn("_c", F.least(F.sum(count).over(order), F.lit(kernels.U32)))
    return after.groupBy(*[c for c in df.columns if c not in ties]).agg(F.min("_c").alias("estimate"))


# ---- Bloom


def bloom_bits(df: DataFrame, capacity: int, error: float, item: str = "item") -> DataFrame:
    """A row for each bit of each item: (…, bit)."""
    size, hashes, _ = kernels.bloom_shape(capacity, error)

    def make(batch):
        bits = kernels.bloom_bits(as_bytes(batch.column(item).to_pylist()), size, hashes)
        ends = np.arange(0, bits.size + 1, hashes, dtype=np.int32)
        return {"_bits": pa.ListArray.from_arrays(pa.array(ends), pa.array(bits.ravel()))}

    placed = _mapped(df, "_bits array<long>", make)
    return placed.select(*df.columns, F.explode("_bits").alias("bit"))


def bloom_filter(df: DataFrame, capacity: int, error: float, item: str = "item") -> DataFrame:
    """BF.MADD in bulk on one link: distinct (key, bit)."""
    return bloom_bits(df.select("key", item).distinct(), capacity, error, item).select("key", "bit").distinct()


def bloom_exists(requests: DataFrame, bits: DataFrame, capacity: int, error: float, item: str = "item") -> DataFrame:
    """BF.MEXISTS: whether all bits of each request (key, item) are set."""
    asked = bloom_bits(requests, capacity, error, item)
    found = asked.join(bits.withColumn("_set", F.lit(True)), ["key", "bit"], "left")
    return found.groupBy(*requests.columns).agg(F.bool_and(F.coalesce("_set", F.lit(False))).alias("found"))


def bloom_card(df: DataFrame, capacity: int, error: float, item: str = "item") -> DataFrame:
    """BF.CARD of filters that took (seq, key, item) in order: an item counts when one of its bits was not set by an earlier one."""
    first = df.groupBy("key", item).agg(F.min("seq").alias("seq"))
    bits = bloom_bits(first, capacity, error, item)
    owner = F.min("seq").over(Window.partitionBy("key", "bit")) == F.col("seq")
    own = bits.withColumn("_own", owner).groupBy("key", item, "seq").agg(F.bool_or("_own").alias("_new"))
    return own.where("_new").groupBy("key").agg(F.count(F.lit(1)).alias("items"))


# ---- order-dependent sketches: one group, one state


def fold(df: DataFrame, schema: str, step) -> DataFrame:
    """``step(key, rows)`` over each key's rows in order of ``seq``; for state that depends on the order."""

    def run(key, frame):
        return step(key[0], frame.sort_values("seq", kind="stable"))

    return df.groupBy("key").applyInPandas(run, schema)


def morris_incrby(df: DataFrame, width: int, depth: int) -> DataFrame:
    """Reply of every MORRIS.INCRBY (seq, key, item, n)."""

    def step(key, rows):
        own = kernels.Morris(width, depth)
        rows["estimate"] = [own.add(item, int(n)) for item, n in zip(as_bytes(rows["item"]), rows["n"], strict=True)]
        return rows[["key", "seq", "item", "estimate"]]

    return fold(df, "key string, seq long, item string, estimate long", step)


def cuckoo_add(df: DataFrame, capacity: int) -> DataFrame:
    """Reply of every CF.ADD (seq, key, item), and how often the filter holds the item then."""

    def step(key, rows):
        own = kernels.Cuckoo(capacity)
        rows["added"] = [own.add(item) for item in as_bytes(rows["item"])]
        rows["copies"] = [own.count(item) for item in as_bytes(rows["item"])]
        return rows[["key", "seq", "item", "added", "copies"]]

    return fold(df, "key string, seq long, item string, added boolean, copies long", step)


def bloom_add(df: DataFrame, capacity: int, error: float, expansion: int) -> DataFrame:
    """Reply of every BF.ADD on a scaling chain, and the number of its links then."""

    def step(key, rows):
        own, added, links = kernels.Bloom(capacity, error, expansion), [], []
        for item in as_bytes(rows["item"]):
            added.append(own.add(item))
            links.append(len(own.links))
        rows["added"], rows["links"] = added, links
        return rows[["key", "seq", "item", "added", "links"]]

    return fold(df, "key string, seq long, item string, added boolean, links int", step)
