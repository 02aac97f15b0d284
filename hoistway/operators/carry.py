"""Running values over a camera's whole history without one task for a camera: windows run within (keys, day), and what earlier or later days hand on comes
from a second window over one row for each key and day. A task so holds a day of a key at most, and every frame grows from one end, so cost is linear.

Order is (ts_us, id). Null keys are a group of their own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
DAY = "__day"


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn(DAY, F.floor(F.col("ts_us") / DAY_US))


def joined(rows: DataFrame, days: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their key's day."""
    renamed = days.withColumnsRenamed({k: f"__k_{k}" for k in [*keys, DAY]})
    same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(renamed[f"__k_{k}"]) for k in [*keys, DAY]])
    return rows.join(renamed, same, "left").drop(*[f"__k_{k}" for k in [*keys, DAY]])


def _nearest(df: DataFrame, keys: list[str], values: dict[str, Column], ahead: bool, own: bool) -> DataFrame:
    order = [F.col("ts_us"), F.col("id")]
    sort, day = ([c.desc() for c in order], F.col(DAY).desc()) if ahead else (order, F.col(DAY))
    pick = F.min_by if ahead else F.max_by
    days = df.groupBy(*keys, DAY).agg(*[pick(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__d_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, DAY, *[F.last(f"__d_{n}", ignorenulls=True).over(earlier).alias(f"__d_{n}") for n in values])
    within = Window.partitionBy(*keys, DAY).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    rows = df.withColumns({n: F.last(v, ignorenulls=True).over(within) for n, v in values.items()})
    return joined(rows, days, keys).withColumns({n: F.coalesce(n, f"__d_{n}") for n in values}).drop(*[f"__d_{n}" for n in values])


def last_before(df: DataFrame, keys: list[str], values: dict[str, Column], own: bool = False) -> DataFrame:
    """Adds for each name the last value that isn't null before the row (or up to it, if own). df has the day of with_day()."""
    return _nearest(df, keys, values, False, own)


def first_after(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the first value that isn't null after the row."""
    return _nearest(df, keys, values, True, False)


def total_up_to(df: DataFrame, keys: list[str], values: dict[str, Column], ties: bool = False) -> DataFrame:
    """Adds for each name the sum of its values up to the row, or up to all rows of its time if ties."""
    days = df.groupBy(*keys, DAY).agg(*[F.sum(v).alias(f"__d_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(*keys, DAY, *[F.sum(f"__d_{n}").over(earlier).alias(f"__d_{n}") for n in values])
    own = Window.partitionBy(*keys, DAY)
    within = own.orderBy("ts_us").rangeBetween(Window.unboundedPreceding, 0) if ties else own.orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({n: F.sum(v).over(within) for n, v in values.items()})
    return joined(rows, days, keys).withColumns({n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__d_{n}", F.lit(0)) for n in values}).drop(*[f"__d_{n}" for n in values])


def last_and_total(df: DataFrame, keys: list[str], last: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """last_before(own=True) and total_up_to() in one pass over the rows and one join with the days."""
    order = F.struct("ts_us", "id")
    days = df.groupBy(*keys, DAY).agg(*[F.max_by(v, F.when(v.isNotNull(), order)).alias(f"__d_{n}") for n, v in last.items()], *[F.sum(v).alias(f"__d_{n}") for n, v in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    handed = [F.last(f"__d_{n}", ignorenulls=True).over(earlier).alias(f"__d_{n}") for n in last] + [F.sum(f"__d_{n}").over(earlier).alias(f"__d_{n}") for n in totals]
    within = Window.partitionBy(*keys, DAY).orderBy("ts_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({n: F.last(v, ignorenulls=True).over(within) for n, v in last.items()} | {n: F.sum(v).over(within) for n, v in totals.items()})
    rows = joined(rows, days.select(*keys, DAY, *handed), keys)
    both = {n: F.coalesce(n, f"__d_{n}") for n in last} | {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"__d_{n}", F.lit(0)) for n in totals}
    return rows.withColumns(both).drop(*[f"__d_{n}" for n in both])


def trailing_peak(points: DataFrame, span_us: int) -> DataFrame:
    """cam, peak, at_us: the most points (cam, ts_us) of a camera within span_us up to and with a point, and the first time of that many. A point counts from its time on and no longer span_us
    later: a running sum over both marks, counted by time first, so that a window isn't walked for each point. Points without a time are a window of their own."""
    times = points.where("cam IS NOT NULL").groupBy("cam", "ts_us").agg(F.count("*").alias("c"))
    known = times.where("ts_us IS NOT NULL")
    marks = known.select("cam", "ts_us", "c", F.lit(True).alias("point")).unionByName(known.select("cam", (F.col("ts_us") + span_us).alias("ts_us"), (-F.col("c")).alias("c"), F.lit(False).alias("point")))
    running = total_up_to(with_day(marks), ["cam"], {"n": F.col("c")}, ties=True).where("point").select("cam", "ts_us", "n")
    running = running.unionByName(times.where("ts_us IS NULL").select("cam", "ts_us", F.col("c").alias("n")))
    best = F.max(F.struct("n", (-F.col("ts_us")).alias("back"))).alias("best")
    return running.groupBy("cam").agg(best).select("cam", F.col("best.n").alias("peak"), (-F.col("best.back")).alias("at_us"))
