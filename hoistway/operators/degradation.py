"""Instruments that go on writing rows and no longer see: boardings for each door opening, and the confidence and number of floor reads, against a camera's own past."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry
from .demand import DAY_US, HOUR_US


@dataclass(frozen=True)
class Starvation:
    """Production values: hours judged as recent, days of history, active hours of the local day, least openings of an hour that is judged, share of the baseline, hours below it that convict, least
    hours of a baseline."""

    recent_h: float = 24.0
    history_d: float = 7.0
    active: tuple[int, int] = (7, 23)
    opens: int = 10
    share: float = 0.40
    hours: int = 6
    base_hours: int = 24


@dataclass(frozen=True)
class Reading:
    """Production values: days judged as recent, days of a baseline, days searched, least reads of a judged day, least days of a baseline, fall of confidence, share of the reads."""

    recent_d: float = 1.0
    base_d: int = 14
    search_d: float = 60.0
    reads: int = 200
    base_days: int = 3
    drop: float = 0.05
    volume: float = 0.40


def upper_median(values: Column) -> Column:
    """Of an array: the middle value of the sorted ones, the upper of two; null where there are none."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def median(values: Column) -> Column:
    """Of an array: the mean of the middle values; null where there are none."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def opens(door: DataFrame) -> DataFrame:
    """cam, ts_us of each change into open; null states count as states."""
    rows = carry.last_before(carry.with_day(door), ["cam"], {"before": F.struct("door_state")})
    return rows.where(F.col("door_state").eqNullSafe("open") & ~F.col("before.door_state").eqNullSafe("open")).select("cam", "ts_us")


def starved(door: DataFrame, transits: DataFrame, now_us: int, local_us: int, p: Starvation = Starvation()) -> DataFrame:
    """cam, state (ok, degraded, no baseline), baseline, recent_median, n_base, n_recent, n_under, n_thin, n_off, first_under_us, door_versions: openings and boardings of an hour from the same history, the ratio
    of recent hours against the upper median of the hours before. Hours are rows here: what is collected for a camera is at most the hours of its history."""
    t0, recent = now_us - int(p.history_d * DAY_US), now_us - int(p.recent_h * HOUR_US)
    hour = ((F.floor((F.col("ts_us") + local_us) / HOUR_US)) * HOUR_US - local_us).cast("long").alias("h")
    door = door.where((F.col("ts_us") >= t0) & (F.col("ts_us") < now_us))
    o = opens(door).groupBy("cam", hour).agg(F.count("*").alias("o"))
    b = transits.where((F.col("ts_us") >= t0) & (F.col("ts_us") < now_us) & (F.col("direction") == "in")).groupBy("cam", hour).agg(F.count("*").alias("b"))
    rows = o.join(b, ["cam", "h"], "full").withColumns({"o": F.coalesce("o", F.lit(0)), "b": F.coalesce("b", F.lit(0)), "hod": F.floor((F.col("h") + local_us) / HOUR_US) % 24})
    active = (F.col("hod") >= p.active[0]) & (F.col("hod") < p.active[1])
    judged, first_recent = active & (F.col("o") >= p.opens), ((recent + local_us) // HOUR_US) * HOUR_US - local_us
    of = lambda when: F.when(judged & when, F.col("b") / F.col("o"))
    is_recent = F.col("h") >= first_recent
    per = rows.groupBy("cam").agg(
        F.collect_list(of(~is_recent)).alias("base"), F.collect_list(F.when(judged & is_recent, F.struct((F.col("b") / F.col("o")).alias("r"), "h"))).alias("late"),
        F.count_if(active & (F.col("o") < p.opens)).alias("n_thin"), F.count_if(~active).alias("n_off"),
    )
    versions = door.where("coalesce(door_version, '') <> ''").groupBy("cam").agg(F.count_distinct("door_version").alias("door_versions"))
    known = F.size("base") >= max(1, p.base_hours)
    per = per.withColumns({"baseline": F.when(known, upper_median(F.col("base"))), "n_base": F.size("base").cast("long"), "n_recent": F.size("late").cast("long")})
    under = F.filter("late", lambda x: x["r"] < p.share * F.col("baseline"))
    per = per.withColumns({"under": F.when(known, under), "recent_median": F.when(known, upper_median(F.transform("late", lambda x: x["r"])))})
    state = F.when(~known, "no baseline").when(F.size("under") >= p.hours, "degraded").otherwise("ok")
    out = per.withColumns({"state": state, "n_under": F.when(known, F.size("under").cast("long")), "first_under_us": F.array_min(F.transform("under", lambda x: x["h"]))})
    return out.join(versions, "cam", "left").select("cam", "state", "baseline", "recent_median", "n_base", "n_recent", "n_under", "n_thin", "n_off", "first_under_us", "door_versions")


def misreading(door: DataFrame, now_us: int, local_us: int, p: Reading = Reading()) -> DataFrame:
    """cam, era, state (ok, degraded, baseline building, no reads), confidence_fell, volume_fell, base_conf, base_reads, recent_conf, recent_reads, n_base: the confident reads of a camera's current era by local
    day, days of enough reads judged against the median of the last base_d judged days before the recent ones. Eras are never pooled; today isn't judged."""
    local_day = F.floor((F.col("ts_us") + local_us) / DAY_US).cast("long")
    today, first_recent = (now_us + local_us) // DAY_US, (now_us - int(p.recent_d * DAY_US) + local_us) // DAY_US
    stated = door.where("coalesce(door_version, '') <> ''")
    current = stated.groupBy("cam").agg(F.max_by("door_version", F.struct("ts_us", "id")).alias("era"))
    sure = F.col("floor").isNotNull() & F.col("read_conf").isNotNull() & F.col("reason").isin("ok", "single_panel")
    days = door.where(sure & (F.col("ts_us") >= now_us - int(p.search_d * DAY_US)) & (local_day < today)).groupBy("cam", F.col("door_version").alias("era"), local_day.alias("day")).agg(F.count("*").alias("n"), F.avg("read_conf").alias("conf"))
    days = days.join(current, ["cam", "era"], "left_semi").withColumns({"late": F.col("day") >= first_recent, "judged": F.col("n") >= p.reads})
    last = F.row_number().over(Window.partitionBy("cam", "late", "judged").orderBy(F.col("day").desc()))  # rows are days
    base = F.col("judged") & ~F.col("late") & (F.col("last") <= p.base_d)
    pick = lambda c, when: F.collect_list(F.when(when, F.col(c)))
    per = days.withColumn("last", last).groupBy("cam").agg(
        pick("conf", base).alias("base_confs"), pick("n", base).alias("base_ns"), F.avg(F.when(F.col("late") & F.col("judged"), F.col("conf"))).alias("recent_conf"),
        F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("recent_reads"), F.count_if("late").alias("recent_days"), F.count_if("judged").alias("judged_days"),
    )
    enough = F.size("base_ns") >= p.base_days
    per = per.withColumns({"n_base": F.size("base_ns").cast("long"), "base_conf": F.when(enough, median(F.col("base_confs"))), "base_reads": F.when(enough, median(F.col("base_ns")))})
    fell = F.coalesce(F.col("base_conf") - F.col("recent_conf") > p.drop, F.lit(False))
    few = F.coalesce((F.col("recent_days") > 0) & (F.col("base_reads") > 0) & (F.col("recent_reads") < p.volume * F.col("base_reads") * max(p.recent_d, 1)), F.lit(False))
    per = per.withColumns({"confidence_fell": fell, "volume_fell": few})
    silent = (F.col("recent_reads") == 0) & (F.col("judged_days") == 0)
    state = F.when(F.col("n_base").isNull() | ~F.col("known") & silent, "no reads").when(~F.col("known"), "baseline building").when(F.col("confidence_fell") | F.col("volume_fell"), "degraded").otherwise("ok")
    out = current.join(per.withColumn("known", enough), "cam", "left").withColumn("state", state)
    return out.select("cam", "era", "state", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("confidence_fell", "volume_fell")], "base_conf", "base_reads", "recent_conf", F.coalesce("recent_reads", F.lit(0)).alias("recent_reads"), F.coalesce("n_base", F.lit(0)).alias("n_base"))
