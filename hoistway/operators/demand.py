"""Demand on one calendar of observed cells: every (hour, camera) of a period stands in it, zero where the camera was observed, null (dark) where it was not.

Observation comes from rows of any stream by quarter hours, judged by their midpoints against declared outages; versions are those declared at a row's own time or at a cell's midpoint.
Counts are pre-aggregated by hour before they meet the calendar, so what is joined and summed up is a row for each hour, camera and version, however many events there are."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import declared_version

US = 1_000_000
HOUR_US, DAY_US, SLOT_US = 3600 * US, 86_400 * US, 900 * US
FLEET = "FLEET"
#: Least lifts for a spread between them.
LEAST_LIFTS = 3


@dataclass(frozen=True)
class Period:
    """[t0, t1) of a building's clock; both at full hours of it."""

    cams: tuple[str, ...]
    t0: int
    t1: int
    local_us: int

    def hour(self, ts: Column) -> Column:
        """Start of the local hour."""
        return (F.floor((ts + self.local_us) / HOUR_US) * HOUR_US - self.local_us).cast("long")

    def day(self, ts: Column) -> Column:
        return F.floor((ts + self.local_us) / DAY_US).cast("long")

    def cells(self, spark: SparkSession) -> DataFrame:
        """hour_us, cam: the calendar."""
        hours = spark.range(self.t0, self.t1, HOUR_US).select(F.col("id").alias("hour_us"))
        return hours.select("hour_us", F.explode(F.array(*[F.lit(c) for c in self.cams])).alias("cam"))

    def within(self, rows: DataFrame, ts: str = "ts_us") -> DataFrame:
        return rows.where((F.col(ts) >= self.t0) & (F.col(ts) < self.t1))


class Outages:
    """Declared outages (start_us, end_us, gap_cam, null for the fleet): a dimension of at most 1,000 rows, checked."""

    def __init__(self, gaps: DataFrame, cams: tuple[str, ...]) -> None:
        rows = gaps.limit(1_001).collect()
        if len(rows) > 1_000:
            raise ValueError("outages are a declared dimension of at most 1,000 rows")
        self.merged: dict[str, list[list[int]]] = {}
        for cam in cams:
            held: list[list[int]] = []
            for lo, hi in sorted((r["start_us"], r["end_us"]) for r in rows if r["gap_cam"] in (None, cam)):
                if held and lo <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], hi)
                else:
                    held.append([lo, hi])
            self.merged[cam] = held

    def _by_cam(self, cam: Column, of: Callable[[list[list[int]]], Column], other: Column) -> Column:
        out = other
        for name, held in self.merged.items():
            out = F.when(cam == name, of(held)).otherwise(out)
        return out

    def at(self, cam: Column, ts: Column) -> Column:
        """Whether the time lies in an outage of the camera."""
        inside = lambda held: F.lit(False) if not held else F.exists(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in held]), lambda g: (ts >= g[0]) & (ts < g[1]))
        return self._by_cam(cam, inside, F.lit(False))

    def within(self, cam: Column, lo: Column, hi: Column) -> Column:
        """Microseconds of [lo, hi) that lie in outages; overlapping ones count once."""
        total = lambda held: sum((F.greatest(F.lit(0), F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a))) for a, b in held), F.lit(0).cast("long"))
        return self._by_cam(cam, total, F.lit(0).cast("long"))


def versioned(rows: DataFrame, ts: Column, epochs: DataFrame, name: str = "version") -> DataFrame:
    """Adds the declared version of the row's camera at a time."""
    return declared_version(rows.withColumn("ts_us", ts), epochs).withColumnRenamed("version", name)


def slots(streams: DataFrame, p: Period, out: Outages) -> DataFrame:
    """cam, slot_us, gapped: quarter hours in which the camera has a row (cam, ts_us) in any stream; gapped if their midpoint is in an outage."""
    found = p.within(streams).where(F.col("cam").isin(*p.cams)).select("cam", (F.floor((F.col("ts_us") - p.t0) / SLOT_US) * SLOT_US + p.t0).cast("long").alias("slot_us")).distinct()
    return found.withColumn("gapped", out.at(F.col("cam"), F.col("slot_us") + SLOT_US // 2))


def observed_hours(seen: DataFrame, p: Period) -> DataFrame:
    return seen.where("NOT gapped").select("cam", p.hour(F.col("slot_us") + SLOT_US // 2).alias("hour_us")).distinct().withColumn("observed", F.lit(True))


def counted(transits: DataFrame, p: Period, out: Outages, epochs: DataFrame) -> DataFrame:
    """hour_us, cam, version, boarded, alighted: crossings outside outages; a direction other than in is an alighting."""
    rows = versioned(p.within(transits).where(F.col("cam").isin(*p.cams) & ~out.at(F.col("cam"), F.col("ts_us"))), F.col("ts_us"), epochs)
    into = F.coalesce((F.col("direction") == "in").cast("long"), F.lit(0).cast("long"))
    return rows.groupBy(p.hour(F.col("ts_us")).alias("hour_us"), "cam", "version").agg(F.sum(into).alias("boarded"), F.sum(1 - into).alias("alighted"))


def hourly_log(transits: DataFrame, streams: DataFrame, p: Period, out: Outages, epochs: DataFrame) -> DataFrame:
    """hour_us, lift, version, boarded, alighted, observed, lifts: a row for each hour, camera and version in play, and FLEET rows by version over the cameras observed."""
    cells = p.cells(transits.sparkSession)
    own = versioned(cells, F.col("hour_us") + HOUR_US // 2, epochs, "declared").drop("ts_us")
    rows = own.join(observed_hours(slots(streams, p, out), p), ["hour_us", "cam"], "left").join(counted(transits, p, out, epochs), ["hour_us", "cam"], "left")
    seen = F.coalesce("observed", F.lit(False))
    rows = rows.select("hour_us", F.col("cam").alias("lift"), F.coalesce("version", "declared").alias("version"), *[F.when(seen, F.coalesce(c, F.lit(0))).alias(c) for c in ("boarded", "alighted")], seen.alias("observed"), F.lit(None).cast("long").alias("lifts"))
    fleet = rows.where("observed").groupBy("hour_us", "version").agg(F.sum("boarded").alias("boarded"), F.sum("alighted").alias("alighted"), F.count("*").alias("lifts"))
    dark = own.where(F.col("cam") == p.cams[0]).join(fleet.select("hour_us").distinct(), "hour_us", "left_anti")
    none = F.lit(None).cast("long")
    fleet = fleet.select("hour_us", F.lit(FLEET).alias("lift"), "version", "boarded", "alighted", F.lit(True).alias("observed"), "lifts")
    return rows.unionByName(fleet).unionByName(dark.select("hour_us", F.lit(FLEET).alias("lift"), F.col("declared").alias("version"), none.alias("boarded"), none.alias("alighted"), F.lit(False).alias("observed"), F.lit(0).cast("long").alias("lifts")))


def daily_log(transits: DataFrame, streams: DataFrame, p: Period, out: Outages, epochs: DataFrame) -> DataFrame:
    """day, cam, version, boarded, alighted, hours_observed, usable_hours, coverage_pct. Both sides of the coverage are hours judged by their own midpoint, so it is 100 at most; null
    where the whole day is an outage. Days without counts on which the camera was never observed don't stand in it."""
    cells = p.cells(transits.sparkSession).withColumn("usable", ~out.at(F.col("cam"), F.col("hour_us") + HOUR_US // 2))
    cells = cells.join(observed_hours(slots(streams, p, out), p), ["hour_us", "cam"], "left").withColumn("day", p.day(F.col("hour_us")))
    days = cells.groupBy("day", "cam").agg(F.count_if("usable").alias("usable_hours"), F.count_if(F.col("usable") & F.col("observed")).alias("hours_observed"))
    totals = counted(transits, p, out, epochs).groupBy(p.day(F.col("hour_us")).alias("day"), "cam", "version").agg(F.sum("boarded").alias("boarded"), F.sum("alighted").alias("alighted"))
    days = versioned(days, F.col("day") * DAY_US - p.local_us + 12 * HOUR_US, epochs, "declared").drop("ts_us").join(totals, ["day", "cam"], "left").where("version IS NOT NULL OR hours_observed > 0")
    pct = F.when(F.col("usable_hours") > 0, 100.0 * F.col("hours_observed") / F.col("usable_hours"))
    return days.select("day", "cam", F.coalesce("version", "declared").alias("version"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("boarded", "alighted")], "hours_observed", "usable_hours", pct.alias("coverage_pct"))


def coverage(streams: DataFrame, p: Period, out: Outages) -> DataFrame:
    """day (null: the period), cam, observed, usable, coverage_pct: quarter hours with rows outside outages, of those that outages leave."""
    spark = streams.sparkSession
    seen = slots(streams, p, out).where("NOT gapped").withColumn("day", p.day(F.col("slot_us")))
    have = seen.groupBy("cam", "day").agg(F.count("*").alias("observed"))
    lo, hi = F.greatest(F.col("day") * DAY_US - p.local_us, F.lit(p.t0)), F.least((F.col("day") + 1) * DAY_US - p.local_us, F.lit(p.t1))
    left = lambda a, b: F.floor((b - a) / SLOT_US) - F.floor(out.within(F.col("cam"), a, b) / SLOT_US)
    days = p.cells(spark).select("cam", p.day(F.col("hour_us")).alias("day")).distinct()
    daily = days.select("cam", "day", F.greatest(F.lit(0), left(lo, hi)).alias("usable")).join(have, ["cam", "day"], "left")
    whole = days.groupBy("cam").agg(F.lit(None).cast("long").alias("day")).withColumn("usable", F.greatest(F.lit(1), left(F.lit(p.t0), F.lit(p.t1)))).join(have.groupBy("cam").agg(F.sum("observed").alias("observed")), "cam", "left")
    observed = F.coalesce("observed", F.lit(0))
    both = daily.select("cam", "day", "usable", observed.alias("observed")).unionByName(whole.select("cam", "day", "usable", observed.alias("observed")))
    return both.withColumn("coverage_pct", F.when(F.col("usable") > 0, F.least(F.lit(100.0), 100.0 * F.col("observed") / F.col("usable"))))


def hour_means(transits: DataFrame, episodes: DataFrame, streams: DataFrame, p: Period, out: Outages, epochs: DataFrame) -> DataFrame:
    """version, lift, hour, observed_days, boarded, alighted (totals), mean_boarded, mean_alighted, lifts. A camera's cell of a day counts if it has rows and isn't all outage (but a second);
    its version is the one at its midpoint. FLEET rows add up the lifts' means. Null where nothing was observed."""
    cells = versioned(p.cells(transits.sparkSession), F.col("hour_us") + HOUR_US // 2, epochs).drop("ts_us")
    rows = slots(streams, p, out).select("cam", p.hour(F.col("slot_us")).alias("hour_us")).distinct()
    live = cells.join(rows, ["cam", "hour_us"]).where(out.within(F.col("cam"), F.col("hour_us"), F.col("hour_us") + HOUR_US) < HOUR_US - US)
    boarded = episodes.select("cam", F.col("start_us").alias("ts_us"), F.coalesce("machine_boarded", F.lit(0)).cast("long").alias("boarded"), F.coalesce("machine_alighted", F.lit(0)).cast("long").alias("alighted"))
    more = versioned(p.within(boarded).where(~out.at(F.col("cam"), F.col("ts_us"))), F.col("ts_us"), epochs).groupBy(p.hour(F.col("ts_us")).alias("hour_us"), "cam", "version").agg(F.sum("boarded").alias("boarded"), F.sum("alighted").alias("alighted"))
    counts = counted(transits, p, out, epochs).unionByName(more).groupBy("hour_us", "cam", "version").agg(F.sum("boarded").alias("boarded"), F.sum("alighted").alias("alighted"))
    hour = (F.floor((F.col("hour_us") + p.local_us) / HOUR_US) % 24).cast("long").alias("hour")
    sums = live.join(counts, ["hour_us", "cam", "version"], "left").groupBy("version", F.col("cam").alias("lift"), hour).agg(
        F.count("*").alias("observed_days"), F.sum(F.coalesce("boarded", F.lit(0))).alias("boarded"), F.sum(F.coalesce("alighted", F.lit(0))).alias("alighted")
    )
    grid = cells.select("version").distinct().select("version", F.explode(F.array(*[F.lit(c) for c in p.cams])).alias("lift")).select("version", "lift", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    lifts = grid.join(sums, ["version", "lift", "hour"], "left").withColumns({"observed_days": F.coalesce("observed_days", F.lit(0)), "mean_boarded": F.col("boarded") / F.col("observed_days"), "mean_alighted": F.col("alighted") / F.col("observed_days"), "lifts": F.lit(None).cast("long")})
    fleet = lifts.groupBy("version", "hour").agg(*[F.sum(c).alias(c) for c in ("observed_days", "boarded", "alighted", "mean_boarded", "mean_alighted")], F.count("mean_boarded").alias("lifts")).withColumn("lift", F.lit(FLEET))
    return lifts.unionByName(fleet)


def peaks(means: DataFrame) -> DataFrame:
    """version, lift, hour, value, mean, ratio, n_hours: each lift's busiest hour (the first of equal ones) over its observed hours; null where nobody boarded."""
    live = means.where("mean_boarded IS NOT NULL").groupBy("version", "lift").agg(F.max(F.struct("mean_boarded", -F.col("hour"))).alias("top"), F.avg("mean_boarded").alias("m"), F.count("*").alias("n_hours"))
    some = F.col("top.mean_boarded") > 0
    out = live.select("version", "lift", F.when(some, -F.col("top")["col2"]).alias("hour"), F.when(some, F.col("top.mean_boarded")).alias("value"), F.when(some, F.col("m")).alias("mean"), F.when(some, F.col("top.mean_boarded") / F.col("m")).alias("ratio"), "n_hours")
    return means.select("version", "lift").distinct().join(out, ["version", "lift"], "left").withColumn("n_hours", F.coalesce("n_hours", F.lit(0)))


def load_balance(means: DataFrame) -> DataFrame:
    """version, hour, lifts, cv: the spread of boardings across lifts; null below LEAST_LIFTS observed lifts or where nobody boarded."""
    live = means.where((F.col("lift") != FLEET)).groupBy("version", "hour").agg(F.count("mean_boarded").alias("lifts"), F.avg("mean_boarded").alias("m"), F.stddev_samp("mean_boarded").alias("sd"))
    return live.select("version", "hour", "lifts", F.when((F.col("lifts") >= LEAST_LIFTS) & (F.col("m") > 0), F.col("sd") / F.col("m")).alias("cv"))


def day_matrix(transits: DataFrame, episodes: DataFrame, streams: DataFrame, p: Period, out: Outages, epochs: DataFrame, current: DataFrame) -> DataFrame:
    """day, cam, boarded, alighted, riders, dark, version, source, mixed, off_era; totals of days (cam null), cameras (day null) and of all (both null). A cell is observed if any stream has
    a row outside outages. Its version is what that day's episodes state, if they agree; mixed if they don't; without episodes the one declared at noon. off_era: another than the camera's current
    one (cam, version in ``current``)."""
    on = p.day(F.col("ts_us")).alias("day")
    free = lambda df: p.within(df).where(F.col("cam").isin(*p.cams) & ~out.at(F.col("cam"), F.col("ts_us")))
    seen = free(streams).groupBy(on, "cam").agg(F.lit(True).alias("seen"))
    counts = counted(transits, p, out, epochs).groupBy(p.day(F.col("hour_us")).alias("day"), "cam").agg(F.sum("boarded").alias("b"), F.sum("alighted").alias("a"))
    direct = p.within(episodes, "start_us").where("coalesce(counting_version, '') <> ''").groupBy(p.day(F.col("start_us")).alias("day"), "cam").agg(F.min("counting_version").alias("least"), F.max("counting_version").alias("most"))
    grid = p.cells(transits.sparkSession).select(p.day(F.col("hour_us")).alias("day"), "cam").distinct().join(seen.select("day").distinct(), "day", "left_semi")
    cells = versioned(grid, F.col("day") * DAY_US - p.local_us + 12 * HOUR_US, epochs, "declared").drop("ts_us")
    cells = cells.join(seen, ["day", "cam"], "left").join(counts, ["day", "cam"], "left").join(direct, ["day", "cam"], "left").join(current.select("cam", F.col("version").alias("now")), "cam", "left")
    mixed = F.coalesce(F.col("least") != F.col("most"), F.lit(False))
    version = F.when(F.col("least").isNull(), F.col("declared")).when(~mixed, F.col("least"))
    count = lambda c: F.when(F.col("seen"), F.coalesce(c, F.lit(0)))
    cells = cells.select("day", "cam", count("b").alias("boarded"), count("a").alias("alighted"), version.alias("version"), F.when(F.col("least").isNull(), "declared").otherwise("episodes").alias("source"), mixed.alias("mixed"), F.when(F.col("seen"), F.coalesce(version != F.col("now"), F.lit(False))).alias("off_era"))
    dark = F.count_if(F.col("boarded").isNull()).alias("dark")
    one = cells.select("day", "cam", "boarded", "alighted", (F.col("boarded") + F.col("alighted")).alias("riders"), F.col("boarded").isNull().cast("long").alias("dark"), "version", "source", "mixed", "off_era")
    totals = None
    for keys in (["day"], ["cam"], []):
        part = cells.groupBy(*keys).agg(F.sum("boarded").alias("boarded"), F.sum("alighted").alias("alighted"), (F.sum("boarded") + F.sum("alighted")).alias("riders"), dark)
        totals = part if totals is None else totals.unionByName(part, allowMissingColumns=True)
    return one.unionByName(totals, allowMissingColumns=True)
