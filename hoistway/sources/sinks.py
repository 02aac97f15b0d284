"""Sinks: tables keyed by era with dynamic partition overwrite, CSV exports with caveats, and the run ledger."""

from __future__ import annotations

import re
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where it is unset and driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="hoistway-")
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once to the shared folder and read back: what is read several times is computed once, and a lost executor costs a file's read. It stays until the folder is cleared."""
    at = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class RunLedger:
    """An append-only table of runs: stage, start, seconds, rows and error of each. Keeping the ledger never fails a run."""

    def __init__(self, spark: SparkSession, path: str, keep_days: float = 14) -> None:
        self.spark, self.path, self.keep_s = spark, path, keep_days * 86_400

    def run(self, stage: str, work: Callable[[], int | None]):
        """What work gives; its duration goes to the ledger, its error too before it is raised again."""
        began, rows, error = time.time(), None, None
        try:
            rows = work()
            return rows
        except Exception as e:
            error = f"{type(e).__name__}: {str(e)[:200]}"
            raise
        finally:
            try:
                one = [(stage, began, time.time() - began, rows if isinstance(rows, int) else None, error)]
                self.spark.createDataFrame(one, "stage string, began double, seconds double, n_rows long, error string").write.mode("append").parquet(self.path)
            except Exception as e:  # noqa: BLE001  a ledger that can't be written must not stop the work
                print(f"run ledger: {type(e).__name__}: {str(e)[:200]}", file=sys.stderr)

    def read(self, now: float) -> DataFrame:
        """The runs of the last keep_days."""
        return self.spark.read.parquet(self.path).where(F.col("began") >= now - self.keep_s)


def materialise(df: DataFrame, path: str, keys: list[str], now: float) -> None:
    """Replaces the partitions that df holds, and no others, so a rerun of an era is idempotent."""
    df.withColumn("computed_at", F.lit(now)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def drop_retired(spark: SparkSession, path: str, keys: list[str], live: DataFrame) -> None:
    """Deletes the partitions of eras that are no longer live. live: the keys that stay."""
    kept = {tuple(r) for r in live.select(*keys).distinct().collect()}
    for r in spark.read.parquet(path).select(*keys).distinct().collect():
        if tuple(r) not in kept:
            remove(spark, "/".join([path, *(f"{k}={v}" for k, v in zip(keys, r))]))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def served(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], now: float, stale_s: float) -> DataFrame:
    """wanted keys with their materialised rows and a state: pending where there are none (never zero), stale beyond the age, else ok."""
    from pyspark.errors import AnalysisException

    try:
        have = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return wanted.withColumns({"age_s": F.lit(None).cast("double"), "state": F.lit("pending")})
    joined = wanted.join(have, keys, "left")
    age = F.lit(now) - F.col("computed_at")
    return joined.withColumn("age_s", age).withColumn("state", F.when(age.isNull(), "pending").when(age > stale_s, "stale").otherwise("ok"))


def export_csv(df: DataFrame, path: str, notes: list[str]) -> None:
    """CSV part files with a header, nulls empty; caveats go to a text file beside them, each line behind "# "."""
    df.write.mode("overwrite").csv(path, header=True, nullValue="")
    df.sparkSession.createDataFrame([(f"# {n}",) for n in notes], "note string").coalesce(1).write.mode("overwrite").text(f"{path}.notes")


def bundle(views: dict[str, Callable[[], DataFrame]], path: str, spark: SparkSession) -> DataFrame:
    """Writes each view on its own; one that fails is named in the manifest with its reason and doesn't stop the others. Returns name, state, reason, seconds."""
    rows = []
    for name, view in views.items():
        began = time.time()
        try:
            export_csv(view(), f"{path}/{name}", [])
            rows.append((name, "ok", None, time.time() - began))
        except Exception as e:  # noqa: BLE001  the manifest carries it
            rows.append((name, "unavailable", f"{type(e).__name__}: {str(e)[:200]}", time.time() - began))
    return spark.createDataFrame(rows, "name string, state string, reason string, seconds double")
