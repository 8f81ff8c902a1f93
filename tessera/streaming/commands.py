"""Streams of commands: a fold with state a key, a log sink, and sketches over event-time windows.

Times to live are compared with each command's own ``ts_ms``, never with the clock of the task, so a replay gives the
same state. A key whose time has passed for every command that can still come, by the watermark over ``ts_ms``, leaves
the state by a timer and gives the DEL record that its next reader would have given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from tessera.operators import sketches
from tessera.plans import fold, router

OUT = "key binary, seq long, kind string, i long, s binary, d double, nested string, error string, records array<array<binary>>"


class KeyFold(StatefulProcessor):
    """Interpreter of single-key commands; the state is the key's image and time to live."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("image", "image binary, expire long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        from tessera.plans import machine_sketch

        name = bytes(key[0])
        m = fold._machine(name)
        if self.state.exists():
            image, expire = self.state.get()
            kind, value = machine_sketch.restore(bytes(image))
            m.put(name, kind, value)
            m.keys[name].expire = expire
        out = []
        frame = pd.concat(list(rows))
        for seq, reply, records in fold._run(fold.rows_of(frame), m):
            out.append((name, *fold.row(seq, reply), records))
        e = m.keys.get(name)
        if e:
            self.state.update((machine_sketch.dump(e.type, e.value), e.expire))
            if e.expire is not None:
                self.handle.registerTimer(e.expire)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            expire = self.state.get()[1]
            # a timer may be of an earlier time to live
            if expire is not None and expire <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
                out.append((bytes(key[0]), None, "expired", None, None, None, None, None, [[b"DEL", bytes(key[0])]]))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
        for name, kind in (("seq", "Int64"), ("i", "Int64"), ("d", "Float64")):
            frame[name] = frame[name].astype(kind)
        yield frame

    def close(self) -> None:
        pass


def fold_stream(commands: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Replies and log records of a stream of single-key commands (seq, ts_ms, client, cmd, args).

    late: how far behind the newest ``ts_ms`` a command may come. Rows of kind "expired", without ``seq``, are those of
    keys that a timer has taken.
    """
    keyed = router.with_keys(commands).withColumn("key", F.try_element_at("keys", F.lit(1))).where(F.col("key").isNotNull())
    timed = keyed.withColumn("_time", F.timestamp_millis("ts_ms")).withWatermark("_time", late)
    return timed.groupBy("key").transformWithStateInPandas(KeyFold(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")


def log_sink(results: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Appends canonical records as (batch, key, seq, records); a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        own = batch.where(F.size("records") > 0).select(F.lit(number).alias("batch"), "key", "seq", "records")
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def each_batch(commands: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Batches through the batch fold: for multi-key commands and transactions, which span state keys."""
    return commands.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def windowed_registers(events: DataFrame, time: str, item: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """HyperLogLog registers by event-time window: (key, start, reg, rank); rows behind the watermark are dropped."""
    placed = sketches.hll_places(events.select(time, F.col(item).cast("string").alias("item")), "item")
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return placed.withWatermark(time, late).groupBy(window.alias("w"), "reg").agg(F.max("rank").alias("rank")).select(F.col("w.start").alias("start"), "reg", "rank")


def windowed_cells(events: DataFrame, time: str, item: str, columns: int, rows: int, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count-Min cells by event-time window."""
    placed = sketches.cms_places(events.select(time, F.col(item).cast("string").alias("item")), columns, rows)
    return placed.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "row", "col").agg(F.count(F.lit(1)).alias("cnt")).select(F.col("w.start").alias("start"), "row", "col", "cnt")
