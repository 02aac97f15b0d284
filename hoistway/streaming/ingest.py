"""Ingest of one stream into several tables, as foreachBatch writers. A batch may be written again after a failure: what it writes is named by its id and replaces itself, and what
it needs of earlier batches is read from them alone, so a second run changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.admission import admit_floors
from ..operators.carry import DAY_US
from ..operators.leftovers import throttled
from ..sources.sinks import remove, shared_dir
from .jobs import validated


def parts(spark: SparkSession, at: str, key: str) -> dict[int, str]:
    """The folders key=<number> in at, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    found = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(path)]
    return {int(name.split("=")[1]): where for name, where in found if name.startswith(f"{key}=") and name.split("=")[1].lstrip("-").isdigit()}


def appended(df: DataFrame, at: str, batch: int) -> None:
    """Adds the batch's rows to a table of days; the same batch again replaces its own part of each day."""
    rows = df.withColumns({"day": F.floor(F.col("ts_us") / DAY_US), "batch": F.lit(batch)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(at)


def table(spark: SparkSession, at: str, columns: str) -> DataFrame:
    """An appended table, empty before its first batch."""
    if not parts(spark, at, "day"):
        return spark.createDataFrame([], columns)
    return spark.read.schema(f"{columns}, day long, batch long").parquet(at).drop("day", "batch")


class DoorIngest:
    """Door events into two tables: doors (floors as admitted, other directions than up and down null) and rejects (unknown camera or state, with the reason)."""

    COLUMNS = "id long, cam string, ts_us long, floor string, direction string, door_state string, reason string"

    def __init__(self, at: str, cams: list[str], ranges: dict[str, tuple[int, int]]) -> None:
        self.at, self.cams, self.ranges = at, cams, ranges

    def write(self, batch: DataFrame, number: int) -> None:
        judged = validated(batch.select([c.split()[0] for c in self.COLUMNS.split(", ")]), self.cams)
        ranges = batch.sparkSession.createDataFrame([(cam, *r) for cam, r in self.ranges.items()], "cam string, lo int, hi int")
        appended(admit_floors(judged.where("reject IS NULL").drop("reject"), ranges), f"{self.at}/doors", number)
        appended(judged.where("reject IS NOT NULL"), f"{self.at}/rejects", number)

    def doors(self, spark: SparkSession) -> DataFrame:
        return table(spark, f"{self.at}/doors", self.COLUMNS)

    def rejects(self, spark: SparkSession) -> DataFrame:
        return table(spark, f"{self.at}/rejects", f"{self.COLUMNS}, reject string")


class HeartbeatIngest:
    """Heartbeats into the current state (the newest of each camera) and a history (one for each least_us, kept keep_us behind the newest of all, by whole days). A heartbeat
    that comes after a later one of its camera changes neither. State is written anew by each batch, a row a camera, with the time that the history last kept; the two newest stay."""

    COLUMNS = "id long, cam string, ts_us long"
    STATE = "cam string, id long, ts_us long, kept_us long"

    def __init__(self, at: str, least_us: int, keep_us: int) -> None:
        self.at, self.least_us, self.keep_us = at, least_us, keep_us

    def _state(self, spark: SparkSession, before: int | None) -> DataFrame:
        held = {n: where for n, where in parts(spark, f"{self.at}/current", "batch").items() if before is None or n < before}
        return spark.read.schema(self.STATE).parquet(held[max(held)]) if held else spark.createDataFrame([], self.STATE)

    def write(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = self._state(spark, number)
        rows = batch.select("id", "cam", "ts_us").where("cam IS NOT NULL AND ts_us IS NOT NULL")
        last = before.select(F.col("cam").alias("__cam"), "kept_us")
        due = rows.join(last, F.col("cam") == F.col("__cam"), "left").where(F.col("kept_us").isNull() | (F.col("ts_us") >= F.col("kept_us") + self.least_us))
        kept = throttled(due.select("cam", "id", "ts_us"), self.least_us)
        newest = rows.select("ts_us").union(before.select("ts_us")).agg(F.max("ts_us")).first()[0]
        if newest is None:
            return
        horizon = (newest - self.keep_us) // DAY_US
        appended(kept.select("id", "cam", "ts_us").where(F.floor(F.col("ts_us") / DAY_US) >= horizon), f"{self.at}/history", number)
        for day, where in parts(spark, f"{self.at}/history", "day").items():
            if day < horizon:
                remove(spark, where)
        none = F.lit(None).cast("long")
        mine = rows.select("cam", "id", "ts_us", none.alias("kept_us")).unionByName(before).unionByName(kept.select("cam", none.alias("id"), none.alias("ts_us"), F.col("ts_us").alias("kept_us")))
        newest_of = F.when(F.col("ts_us").isNotNull(), F.struct("ts_us", "id"))
        state = mine.groupBy("cam").agg(F.max(newest_of).alias("last"), F.max("kept_us").alias("kept_us"))
        state.select("cam", "last.id", "last.ts_us", "kept_us").write.mode("overwrite").parquet(f"{self.at}/current/batch={number}")
        for n, where in parts(spark, f"{self.at}/current", "batch").items():
            if n < number - 1:
                remove(spark, where)

    def current(self, spark: SparkSession) -> DataFrame:
        return self._state(spark, None).drop("kept_us")

    def history(self, spark: SparkSession) -> DataFrame:
        return table(spark, f"{self.at}/history", self.COLUMNS)


def ingest(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    """Runs a stream's batches through a writer until nothing is left to read."""
    at = f"{shared_dir(stream.sparkSession)}/ingest-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(write).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    remove(stream.sparkSession, at)
