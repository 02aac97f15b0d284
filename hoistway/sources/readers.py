"""Sources beside Parquet: NDJSON events, comment CSVs, worker logs, JSON sidecars and directory ages. All readers only read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import struct


def ndjson(spark: SparkSession, path: str, ddl: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines): a line that isn't a JSON object of the schema is kept aside, never guessed at."""
    reader = spark.readStream if stream else spark.read
    parsed = reader.text(path).select("value", F.from_json("value", struct(ddl + ", _bad string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select([f"r.{f.name}" for f in struct(ddl)]), parsed.where(bad).select("value")


def comment_csv(spark: SparkSession, path: str, ddl: str, header: bool = True) -> DataFrame:
    """CSV whose leading lines with # are notes."""
    return spark.read.csv(path, schema=struct(ddl), header=header, comment="#")


def log_samples(spark: SparkSession, path: str, pattern: str, fields: dict[str, str]) -> DataFrame:
    """One row for each log line that matches: fields name the pattern's groups in order, with their types."""
    line = spark.read.text(path).where(F.col("value").rlike(pattern))
    return line.select([F.regexp_extract("value", pattern, i).try_cast(kind).alias(name) for i, (name, kind) in enumerate(fields.items(), 1)])


def sidecar(spark: SparkSession, path: str, ddl: str, multi_line: bool = True) -> DataFrame:
    """JSON sidecars, one a file or one a line; a missing or unreadable one is empty, that is unknown."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(struct(ddl)).option("mode", "DROPMALFORMED").option("multiLine", multi_line).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], struct(ddl))


def newest_files(spark: SparkSession, path: str, camera_pattern: str = r"/(ch[0-9]+)/") -> DataFrame:
    """cam, newest: the time of the newest file in each camera's folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", camera_pattern, 1).alias("cam"), "modificationTime")
    return files.where("cam <> ''").groupBy("cam").agg(F.max("modificationTime").alias("newest"))


def iso_to_us(text: Column) -> Column:
    """Epoch microseconds of an ISO time; one without offset is on the building's clock (+05:30), a day alone is its midnight; null if it can't be read."""
    text = F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.concat(text, F.lit("T00:00:00"))).when(text.rlike(r"^[0-9-]{10}[T ][0-9]{2}:[0-9]{2}$"), F.concat(text, F.lit(":00"))).otherwise(text)
    has_zone = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    whole = F.regexp_replace(F.when(has_zone, text).otherwise(F.concat(text, F.lit("+05:30"))), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.unix_micros(F.try_to_timestamp(whole))
