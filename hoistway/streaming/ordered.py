"""Machines over a stream in the order of event time, whatever the order and the batches in which rows come.

A row waits in keyed state until the watermark has passed it; then all that is due goes through the key's machine by (ts_us, id). Rows within the lateness therefore give the
same result in any order of files and any cut into batches; later ones are dropped. State is the rows of one lateness and the machine. A key without new rows is
woken by a timer. close_stream() ends a stream that has no more rows: its last rows come out too.

A machine has step(row) and expire(us), both giving output rows (tuples without the key), due() (when it wants to be woken, or None), and saved()."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..sources.sinks import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of the row that closes a stream: far ahead of any other.
END_US = 4_000_000_000_000_000
#: Width of a slot of the buffer: rows wait by slots, so that only slots that are due are read.
SLOTS = 16
#: Rows that a task holds before it hands them to state, and rows of a frame of output.
HELD, OUT = 50_000, 10_000


def plain(x):
    """A cell as JSON has it."""
    if isinstance(x, (list, np.ndarray)):
        return [plain(y) for y in x]
    x = x.item() if isinstance(x, np.generic) else x
    return None if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x else x


class _InOrder(StatefulProcessor):
    """Rows (ts_us, id, and more as JSON) wait in a map of slots of time, in parts as they came; the machine's state is a JSON text. A task holds HELD rows on the way in and a slot on the way out,
    however many come at once."""

    def __init__(self, make: Callable[[object], object], columns: list[str], out: list[str], keys: list[str], slot_us: int) -> None:
        self.make, self.columns, self.out, self.keys, self.slot_us = make, columns, out, keys, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "rows string")
        self.parts = handle.getValueState("parts", "next long")
        self.state = handle.getValueState("machine", "saved string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, list] = {}
        held, first = 0, self.parts.get()[0] if self.parts.exists() else 0
        part = first
        for batch in rows:
            for r in batch[self.columns].to_dict("split")["data"]:
                if r[0] < END_US:
                    slots.setdefault(int(r[0]) // self.slot_us, []).append([plain(x) for x in r])
                    held += 1
            if held >= HELD:
                self._keep(slots, part)
                slots, held, part = {}, 0, part + 1
        if slots:
            self._keep(slots, part)
            part += 1
        if part > first:
            self.parts.update((part,))
        return self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _keep(self, slots: dict[int, list], part: int) -> None:
        for slot, new in slots.items():
            self.waiting.updateValue((slot, part), (json.dumps(new),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._release(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _release(self, key, watermark_us: int) -> Iterator[pd.DataFrame]:
        saved = self.state.get()[0] if self.state.exists() else None
        machine, next_us, left, found = self.make(None if saved is None else json.loads(saved)), None, False, []
        for slot, parts in groupby(sorted(tuple(k) for k in self.waiting.keys()), key=lambda k: k[0]):
            if slot * self.slot_us >= watermark_us:
                next_us, left = slot * self.slot_us if next_us is None else next_us, True
                break
            due = []
            for at in parts:
                rows = json.loads(self.waiting.getValue(at)[0])
                later = [r for r in rows if r[0] >= watermark_us]
                due += [r for r in rows if r[0] < watermark_us]
                if not later:
                    self.waiting.removeKey(at)
                    continue
                left, soonest = True, min(r[0] for r in later)
                next_us = soonest if next_us is None else min(next_us, soonest)
                if len(later) < len(rows):
                    self.waiting.updateValue(at, (json.dumps(later),))
            for r in sorted(due, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
                found += machine.step(dict(zip(self.columns, r)))
            if len(found) >= OUT:
                yield self._frame(key, found)
                found = []
        found += machine.expire(watermark_us)
        after = machine.saved()
        if after is not None:
            if json.dumps(after) != saved:
                self.state.update((json.dumps(after),))
        elif saved is not None:
            self.state.clear()
        if not left and self.parts.exists():
            self.parts.clear()
        times = [t for t in (next_us, machine.due()) if t is not None]
        if times:
            self.handle.registerTimer(max(min(times), watermark_us) // 1000 + 1)
        yield self._frame(key, found)

    def _frame(self, key, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *f) for f in found], columns=[*self.keys, *self.out])


def in_order(rows: DataFrame, keys: list[str], columns: list[str], make: Callable[[object], object], out: str, late_us: int) -> DataFrame:
    """rows (a stream with keys, ts_us, id and further columns) through a machine for each key; ``columns`` begin with ts_us and id. ``out``: its output's columns
    after the keys. Rows more than late_us behind the newest are dropped."""
    timed = rows.withColumn("__at", F.timestamp_micros("ts_us")).withWatermark("__at", f"{late_us // 1000} milliseconds")
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [out])
    processor = _InOrder(make, columns, [c.split()[0] for c in out.split(", ")], keys, max(1_000, late_us // SLOTS))
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")


class Closable:
    """A stream that can be ended: the rows of ``stream`` and, once close() was called, one row at END_US that moves the watermark past all others. Its other columns are
    null or as in ``fill``: what a join or filter asks not to be null must be filled, as Spark drops such rows before it looks at their time."""

    def __init__(self, stream: DataFrame, fill: dict[str, object] | None = None) -> None:
        self.spark, self.fill = stream.sparkSession, {"ts_us": END_US, **(fill or {})}
        self.at = f"{shared_dir(self.spark)}/clock-{uuid.uuid4().hex}"
        _path(self.spark, self.at, lambda fs, p: fs.mkdirs(p))
        self.schema = StructType([StructField(f.name, f.dataType) for f in stream.schema])
        both = stream.unionByName(self.spark.readStream.schema(self.schema).parquet(self.at))
        there = F.col("ts_us").isNotNull()  # always; but so every other column may be null in state, whether or not the stream is closed yet
        self.rows = both.select(*[c if c == "ts_us" else F.when(there, F.col(c)).alias(c) for c in both.columns])

    def close(self) -> None:
        row = self.spark.createDataFrame([tuple(self.fill.get(f.name) for f in self.schema)], self.schema)
        row.coalesce(1).write.mode("append").parquet(self.at)


def _path(spark: SparkSession, at: str, do) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    do(path.getFileSystem(spark._jsc.hadoopConfiguration()), path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within the block streams keep their state in RocksDB, on disk and not on the heap."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before is not None else spark.conf.unset(PROVIDER)


def drain(result: DataFrame, inputs: list[Closable]) -> DataFrame:
    """Runs a stream over all that is available, closes its inputs, runs it on to its end, and reads what it wrote. Its state and clocks are removed; ``drain.progress`` keeps the last
    progress of the run."""
    spark = result.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def run() -> None:
        query = result.writeStream.format("parquet").option("path", f"{at}/table").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        drain.progress = query.lastProgress

    with rocksdb(spark):
        run()
        for i in inputs:
            i.close()
        run()
    for gone in [f"{at}/state", *(i.at for i in inputs)]:
        _path(spark, gone, lambda fs, p: fs.delete(p, True))
    return spark.read.schema(result.schema).parquet(f"{at}/table")
