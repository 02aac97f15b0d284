"""What an ingest admits: floor labels by shape and by each camera's registered range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the shape of a floor label.
LABEL = "^(G|P[0-9]|[0-9]{1,2})$"


def admit_floors(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows with floor and reason as admitted: a label of another shape, or a number outside its camera's registered range (ranges: cam, lo, hi; a row a camera), becomes null with
    the reason invalid_label:<its first 24 characters>. Cameras without a range admit every number; a null floor stays as it is, with its reason."""
    known = ranges.select(F.col("cam").alias("__cam"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    number = F.expr("try_cast(floor AS INT)")
    ok = F.col("floor").rlike(LABEL) & (number.isNull() | F.col("__lo").isNull() | number.between(F.col("__lo"), F.col("__hi")))
    bad = F.col("floor").isNotNull() & ~ok
    judged = rows.join(known, F.col("cam") == F.col("__cam"), "left").withColumn("__bad", bad)
    reason = F.when(F.col("__bad"), F.concat(F.lit("invalid_label:"), F.substring("floor", 1, 24))).otherwise(F.col("reason"))
    return judged.withColumn("reason", reason).withColumn("floor", F.when(~F.col("__bad"), F.col("floor"))).drop("__cam", "__lo", "__hi", "__bad")
