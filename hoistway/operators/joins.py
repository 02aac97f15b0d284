"""Interval and as-of joins. The equi-key is (camera, time slot): intervals are copied into the slots they touch, so a busy camera is spread over its slots
instead of standing in one task; bounds are checked again after the join. As-of joins run over a union with last(ignore nulls)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry

US = 1_000_000


def point_in_interval(points: DataFrame, intervals: DataFrame, lo: str, hi: str, slot_us: int, how: str = "inner") -> DataFrame:
    """Pairs with the same cam and lo <= ts_us <= hi, ends included. Each pair meets in exactly one slot: the point's."""
    spread = intervals.withColumn("__slot", F.explode(F.sequence(F.floor(F.col(lo) / slot_us), F.floor(F.col(hi) / slot_us))))
    p, i = points.withColumn("__slot", F.floor(F.col("ts_us") / slot_us)).alias("p"), spread.alias("i")
    on = (F.col("p.cam") == F.col("i.cam")) & (F.col("p.__slot") == F.col("i.__slot")) & (F.col("p.ts_us") >= F.col(f"i.{lo}")) & (F.col("p.ts_us") <= F.col(f"i.{hi}"))
    return p.join(i, on, how)


def declared_version(points: DataFrame, epochs: DataFrame) -> DataFrame:
    """Adds version: the latest fleet epoch at or before the point; a camera's own stamp overrides it if it is later than that cut. Epochs are a
    declared dimension of a few rows, checked against its bound before it becomes an expression."""
    if epochs.count() > 1_000:
        raise ValueError("version epochs are a declared dimension of at most 1,000 rows")
    rows = sorted(((r["from_us"], r["cam"], r["version"]) for r in epochs.collect()), key=lambda r: (r[0], r[1] is not None))
    out: Column = F.lit("pre-declared")
    for start, cam, version in rows:
        holds = F.col("ts_us") >= start
        out = F.when(holds if cam is None else holds & (F.col("cam") == cam), F.lit(version)).otherwise(out)
    return points.withColumn("version", out)


def nearest_window(points: DataFrame, windows: DataFrame) -> DataFrame:
    """Adds distance_us: 0 within a window, else to the end of the previous or the start of the next one of the camera; null outside all windows' span.
    windows: cam, lo, hi. One pass over the union of both, ordered by time."""
    marks = windows.select("cam", F.col("lo").alias("ts_us"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("point"), "lo", "hi")
    rows = points.select("cam", "ts_us", F.lit(1).alias("kind"), F.col("id").alias("point"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")).unionByName(marks)
    rows = carry.with_day(rows.withColumn("id", F.struct("kind", "point")))  # windows that start at a point's time come before it
    w = Window.partitionBy("cam", carry.DAY).orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    days = rows.groupBy("cam", carry.DAY).agg(F.max("hi").alias("reach"))
    days = days.withColumn("reach", F.max("reach").over(Window.partitionBy("cam").orderBy(carry.DAY).rowsBetween(Window.unboundedPreceding, -1)))
    rows = carry.joined(rows.withColumn("own_end", F.max("hi").over(w)), days, ["cam"]).withColumn("end", F.greatest("own_end", "reach"))
    rows = carry.first_after(rows, ["cam"], {"next": F.col("lo")})
    after = F.when(F.col("end").isNotNull(), F.greatest(F.lit(0), F.col("ts_us") - F.col("end")))
    before = F.col("next") - F.col("ts_us")
    inside_span = F.col("end").isNotNull() & (F.col("next").isNotNull() | (F.col("ts_us") <= F.col("end")))
    return rows.where("kind = 1").select("cam", F.col("point").alias("id"), "ts_us", F.when(inside_span, F.least(after, F.coalesce(before, after))).alias("distance_us"))


def interval_overlap(a: DataFrame, b: DataFrame, slot_us: int) -> DataFrame:
    """Pairs (as a and b) with the same cam and a.lo < b.hi and b.lo < a.hi. Both are copied into the slots they touch; a pair counts in the first slot that they share."""
    slots = F.explode(F.sequence(F.floor(F.col("lo") / slot_us), F.floor(F.greatest(F.col("lo"), F.col("hi") - 1) / slot_us)))
    a, b = a.withColumn("__slot", slots).alias("a"), b.withColumn("__slot", slots).alias("b")
    first = F.greatest(F.floor(F.col("a.lo") / slot_us), F.floor(F.col("b.lo") / slot_us))
    same = (F.col("a.cam") == F.col("b.cam")) & (F.col("a.__slot") == F.col("b.__slot")) & (F.col("a.lo") < F.col("b.hi")) & (F.col("b.lo") < F.col("a.hi"))
    return a.join(b, same & (F.col("a.__slot") == first))


def with_overlap(rows: DataFrame, others: DataFrame, name: str, slot_us: int) -> DataFrame:
    """Adds how much of each row (cam, lo, hi) the others cover; others of one cam don't overlap each other."""
    pairs = interval_overlap(rows.select("cam", "lo", "hi").distinct(), others.select("cam", "lo", "hi"), slot_us)
    shared = F.least("a.hi", "b.hi") - F.greatest("a.lo", "b.lo")
    covered = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in ("cam", "lo", "hi")]).agg(F.sum(shared).alias(name))
    return rows.join(covered, ["cam", "lo", "hi"], "left").withColumn(name, F.coalesce(name, F.lit(0)))


def attributed(points: DataFrame, episodes: DataFrame, pad_us: int, slot_us: int = 6 * 3600 * US) -> DataFrame:
    """points whose episode_id is null get the least id of the episodes around them, if any; what is set stays."""
    spans = episodes.select("cam", F.col("id").alias("found"), (F.col("start_us") - pad_us).alias("lo"), (F.col("end_us") + pad_us).alias("hi"))
    best = point_in_interval(points.where("episode_id IS NULL"), spans, "lo", "hi", slot_us).groupBy("p.id").agg(F.min("i.found").alias("found"))
    return points.join(best, "id", "left").withColumn("episode_id", F.coalesce("episode_id", "found")).drop("found")
