"""Schemas of the lift-traffic tables. Optional columns are added as typed nulls, so a reader never mistakes an absent feature for zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

DOOR = "id long, gateway_id string, cam string, ts_us long, floor string, direction string, door_state string, read_conf double, reason string, close_travel_s double, door_version string, seq long"
TRANSIT = "id long, gateway_id string, cam string, ts_us long, ts_bucket long, direction string, track_id long"
EPISODE = "id long, gateway_id string, cam string, start_us long, end_us long, machine_boarded int, machine_alighted int, human_boarded int, human_alighted int, occupancy_frames int, occupancy_max int, occupancy_degraded boolean, counting_version string, status string"
CYCLE = "id long, source_id long, open_start string, open_full string, close_start string, close_full string, close_travel_s double, quality string, floor string, boarded int, alighted int"


def struct(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema: missing ones as typed nulls, others cast, extra ones dropped."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(ddl)])


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table that isn't there is empty; any other failure is raised."""
    from pyspark.errors import AnalysisException

    try:
        return conform(spark.read.parquet(path), ddl)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], struct(ddl))
