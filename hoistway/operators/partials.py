"""Cycle figures from mergeable partial aggregates.

A partial row is (camera, era, local day, local hour, kind, v, n, s, ss, first_us, last_us): counters (n), value counts of a pool (v, n), and sums (n, s, ss). Adding rows up by kind and value is all
that merging takes, so any window, period or set of eras is folded from stored partials without reading a cycle again; order statistics come from the value counts and are exact.
Stored partials are partitioned by day with a fingerprint of each day's cycles: refresh() rewrites the days that changed and no others."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..sources import sinks
from .demand import DAY_US, HOUR_US, Outages
from .leftovers import quantum_of

ERA = ["cam", "door_version"]
KEYS = [*ERA, "day", "hour"]
#: Least close travel that counts, seconds a person by the sheet, compliance line, edges of the histograms, share at the sampling quantum that makes a pool unreadable, share of
#: floor rejections to warn of.
FLOOR_S, PER_PERSON, CLIFF_S = 0.5, 1.5, 2.31
CLOSE_EDGES = (0.5, 1.0, 1.5, 2.0, 2.31, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0)
DWELL_EDGES = (2.0, 4.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, 60.0)
SUPPRESS, WARN = 0.20, 0.05
COUNTERS = ("cycles", "in_gap", "excluded", "floor_rejected", "counted", "boarded", "alighted")
POOLS = ("close", "prefilter", "dwell", "open", "travel")
SUMS = ("transfer", "lost", "pax")


def partials(cycles: DataFrame, out: Outages, local_us: int, floor_s: float = FLOOR_S, per_person: float = PER_PERSON) -> DataFrame:
    """Partial rows of cycles: ERA, ts_us (null where the start wasn't seen: the close's time stands for it), close_us, class, close_travel_s, open_travel_s, dwell_s, boarded, alighted (null
    where nobody counted). Cycles within outages are counted as such and left out of all else."""
    at = F.coalesce("ts_us", "close_us")
    c = cycles.withColumns({"at": at, "gapped": out.at(F.col("cam"), at)})
    clean, travel = (F.col("class") == "clean") & F.col("close_travel_s").isNotNull(), F.col("close_travel_s")
    load = F.coalesce("boarded", F.lit(0)) + F.coalesce("alighted", F.lit(0))
    held = (load > 0) & (F.col("dwell_s") > 0)

    def item(kind: str, when: Column, v: Column | None = None, n: Column | None = None, x: Column | None = None) -> Column:
        x = F.lit(None).cast("double") if x is None else x.cast("double")
        return F.when(when, F.struct(F.lit(kind).alias("kind"), (F.lit(None) if v is None else v).cast("double").alias("v"), (F.lit(1) if n is None else n).cast("long").alias("n"), x.alias("s"), (x * x).alias("ss")))

    free = ~F.col("gapped")
    items = [
        item("in_gap", F.col("gapped")),
        item("cycles", free),
        item("excluded", free & ~F.coalesce(clean, F.lit(False))),
        item("floor_rejected", free & clean & (travel < floor_s)),
        item("counted", free & F.col("boarded").isNotNull()),
        item("boarded", free & F.col("boarded").isNotNull(), n=F.col("boarded")),
        item("alighted", free & F.col("alighted").isNotNull(), n=F.col("alighted")),
        item("close", free & clean & (travel >= floor_s), travel),
        item("prefilter", free & clean, travel),
        item("dwell", free & (F.col("dwell_s") > 0), F.col("dwell_s")),
        item("open", free & (F.col("open_travel_s") > 0), F.col("open_travel_s")),
        item("travel", free & travel.isNotNull(), travel),
        item("travel", free & (F.col("open_travel_s") > 0), F.col("open_travel_s")),
        item("transfer", free & held, x=F.col("dwell_s") / load),
        item("lost", free & held, x=F.col("dwell_s") - per_person * load),
        item("pax", free & F.col("boarded").isNotNull(), x=F.col("boarded")),
    ]
    hour = F.floor((F.col("at") + local_us) / HOUR_US).cast("long")
    flat = c.select(*ERA, F.floor(hour / 24).cast("long").alias("day"), (hour % 24).alias("hour"), "at", F.explode(F.filter(F.array(*items), lambda i: i.isNotNull())).alias("i"))
    return flat.groupBy(*KEYS, "i.kind", "i.v").agg(F.sum("i.n").alias("n"), F.sum("i.s").alias("s"), F.sum("i.ss").alias("ss"), F.min("at").alias("first_us"), F.max("at").alias("last_us"))


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Partials of coarser keys (which may be new columns, such as a window's name)."""
    return rows.groupBy(*keys, "kind", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def refresh(cycles: DataFrame, path: str, out: Outages, local_us: int, now: float, per_person: float = PER_PERSON) -> list[int]:
    """Brings the stored partials up to date with all cycles so far, and returns the days it wrote, of which there are as many as changed. A day that lost its cycles goes."""
    spark = cycles.sparkSession
    day = F.floor((F.coalesce("ts_us", "close_us") + local_us) / DAY_US).cast("long")
    marks = cycles.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64(*cycles.columns), 20)).alias("mark"))
    try:
        before = spark.read.schema("day long, n long, mark long").parquet(f"{path}/marks")
        stored = marks.withColumnsRenamed({"n": "n1", "mark": "m1"}).join(before, "day", "full")
        days = stored.where("NOT (n1 <=> n AND m1 <=> mark)").select("day", F.col("n1").isNull().alias("gone")).collect()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        days = [r for r in marks.select("day", F.lit(False).alias("gone")).collect()]
    changed = [r.day for r in days if not r.gone]
    if changed:
        sinks.materialise(partials(cycles.where(day.isin(changed)), out, local_us, per_person=per_person), f"{path}/days", ["day"], now)
    for r in days:
        if r.gone:
            sinks.remove(spark, f"{path}/days/day={r.day}")
    if days:
        kept = [tuple(r) for r in marks.collect()]
        spark.createDataFrame(kept, "day long, n long, mark long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks")
    return sorted(r.day for r in days)


def stored_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/days").withColumn("day", F.col("day").cast("long")).drop("computed_at")


def _histogram(edges: tuple[float, ...]) -> Column:
    """Aggregate: how many values lie below each edge and at or above the one before, and above the last."""
    bounds = [None, *edges, None]
    return F.array(*[F.coalesce(F.sum(F.when((F.lit(True) if lo is None else F.col("v") >= lo) & (F.lit(True) if hi is None else F.col("v") < hi), F.col("c"))), F.lit(0)) for lo, hi in zip(bounds, bounds[1:])])


def _mean(n: Column, s: Column, ss: Column, name: str) -> list[Column]:
    """mean, lo, hi: the normal interval of a mean; no bounds below two values."""
    m = s / n
    half = stats.Z95 * F.sqrt(F.greatest(F.lit(0.0), (ss - n * m * m) / (n - 1))) / F.sqrt(n)
    return [F.when(n > 0, m).alias(f"{name}_mean"), F.when(n > 1, m - half).alias(f"{name}_mean_lo"), F.when(n > 1, m + half).alias(f"{name}_mean_hi")]


def pool(rows: DataFrame, keys: list[str], kind: str, edges: tuple[float, ...] = (), cliff_s: float | None = None) -> DataFrame:
    """keys and the figures of a pool, by name: n, median with interval, p85, least and most value, mean with interval, histogram and share beyond the cliff with interval, where asked for."""
    counts = rows.where(F.col("kind") == kind).select(*keys, "v", F.col("n").alias("c"))
    lo, hi = stats.median_interval()
    n, c, v = F.max("n").cast("double"), F.col("c"), F.col("v")
    figures = [F.max("n").alias(f"{kind}_n"), stats.nearest_rank(0.5).alias(f"{kind}_median"), stats.nearest_rank(0.85).alias(f"{kind}_p85"), lo.alias(f"{kind}_median_lo"), hi.alias(f"{kind}_median_hi"), F.min("v").alias(f"{kind}_least"), F.max("v").alias(f"{kind}_most")]
    figures += _mean(n, F.sum(v * c), F.sum(v * v * c), kind)
    if edges:
        figures.append(_histogram(edges).alias(f"{kind}_hist"))
    if cliff_s is not None:
        figures.append(F.coalesce(F.sum(F.when(v > cliff_s, c)), F.lit(0)).alias("over"))
    out = stats.ranked_counts(counts, keys).groupBy(*keys).agg(*figures)
    if cliff_s is not None:
        over_lo, over_hi = stats.wilson(F.col("over"), F.col(f"{kind}_n"))
        out = out.withColumns({"over_pct": 100.0 * F.col("over") / F.col(f"{kind}_n"), "over_lo": over_lo, "over_hi": over_hi})
    return out


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the counters, first_us and last_us of the cycles, and mean and interval of the sums."""
    total = lambda kind, c: F.sum(F.when(F.col("kind") == kind, F.col(c)))
    out = rows.groupBy(*keys).agg(
        *[F.coalesce(total(k, "n"), F.lit(0)).alias(k) for k in COUNTERS],
        F.min(F.when(F.col("kind") == "cycles", F.col("first_us"))).alias("first_us"), F.max(F.when(F.col("kind") == "cycles", F.col("last_us"))).alias("last_us"),
        *[total(k, c).alias(f"{k}_{c}") for k in SUMS for c in ("n", "s", "ss")],
    )
    means = [c for k in SUMS for c in _mean(F.col(f"{k}_n").cast("double"), F.col(f"{k}_s"), F.col(f"{k}_ss"), k)]
    return out.select(*keys, *COUNTERS, "first_us", "last_us", *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"{k}_n") for k in SUMS], *means)


def summary(rows: DataFrame, keys: list[str], cliff_s: float = CLIFF_S) -> DataFrame:
    """All figures of cycles by keys, from partials."""
    rows = merged(rows, keys)
    parts = [pool(rows, keys, "close", CLOSE_EDGES, cliff_s), pool(rows, keys, "prefilter").select(*keys, "prefilter_n", "prefilter_median", "prefilter_p85"), pool(rows, keys, "dwell", DWELL_EDGES), pool(rows, keys, "open")]
    out = reduce(lambda a, b: a.join(b, keys, "left"), parts, counters(rows, keys))
    out = out.withColumns({f"{k}_n": F.coalesce(f"{k}_n", F.lit(0)) for k in ("close", "prefilter", "dwell", "open")})
    share = F.when(F.col("prefilter_n") > 0, F.col("floor_rejected") / F.col("prefilter_n"))
    return out.withColumns({"floor_reject_share": share, "floor_reject_warn": F.coalesce(share > WARN, F.lit(False))})


def with_rate(figures: DataFrame, out: Outages, t0: int, t1: int) -> DataFrame:
    """Adds covered_s (the period without the camera's outages) and cycles_per_hour."""
    covered = (F.lit(t1 - t0) - out.within(F.col("cam"), F.lit(t0), F.lit(t1))) / 1_000_000
    return figures.withColumn("covered_s", covered).withColumn("cycles_per_hour", F.when(F.col("covered_s") > 0, F.col("cycles") / (F.col("covered_s") / 3600)))


def resolution(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, quantum_s, source, and for close and open travel the share at the quantum and whether the pool is bound by it. The quantum is found in each era's own travels; where it
    isn't, the median of the others stands in, and one within tolerance of that is taken for it. Only value counts of a key meet in a task."""
    rows, kinds = merged(rows, keys), dict(rows.dtypes)

    def detect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf.v > 0].sort_values("v")
        return pd.DataFrame([(*key, quantum_of(pdf["v"].to_numpy(), pdf["n"].to_numpy()) if len(pdf) else None)], columns=[*keys, "own"])

    own = rows.where("kind = 'travel'").select(*keys, "v", "n").groupBy(*keys).applyInPandas(detect, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", own double")
    own = rows.select(*keys).distinct().join(own, keys, "left")
    fleet = own.where("own IS NOT NULL").agg(F.sort_array(F.collect_list("own")).alias("all")).select(F.get("all", F.floor(F.size("all") / 2).cast("int")).alias("fleet"))  # one number an era
    tolerance = lambda q: F.greatest(F.lit(0.003), 0.02 * q)
    both = own.join(F.broadcast(fleet), how="cross")
    snapped = F.when(F.col("own").isNull(), F.col("fleet")).when(F.abs(F.col("own") - F.col("fleet")) <= tolerance(F.col("fleet")), F.col("fleet")).otherwise(F.col("own"))
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("fleet").isNotNull(), "others").otherwise("undetermined")
    both = both.select(*keys, snapped.alias("quantum_s"), source.alias("source"))
    for kind, name in (("prefilter", "close"), ("open", "open")):
        pinned = rows.where((F.col("kind") == kind) & (F.col("v") > 0)).join(both.select(*keys, "quantum_s"), keys)
        pinned = pinned.groupBy(*keys).agg((F.sum(F.when(F.abs(F.col("v") - F.col("quantum_s")) <= tolerance(F.col("quantum_s")), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.max("quantum_s").alias("q"))
        both = both.join(pinned.select(*keys, F.when(F.col("q").isNotNull(), F.col("share")).alias(f"{name}_at_quantum")), keys, "left").withColumn(f"{name}_suppressed", F.coalesce(F.col(f"{name}_at_quantum") > SUPPRESS, F.lit(False)))
    return both


def profile(rows: DataFrame, keys: list[str], windows: dict[str, tuple[int, int]], n_days: int) -> DataFrame:
    """keys, window, hours and the window's figures: rates an hour of n_days days, close travel, transfer, and the ratio to the all-day rate (1 where that is 0). windows: name, [from, to) hours of the
    local day; 'all' must be among them."""
    table = F.array(*[F.struct(F.lit(name).alias("window"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for name, (lo, hi) in windows.items()])
    held = rows.withColumn("w", F.explode(table)).where("hour >= w.lo AND hour < w.hi").select("*", F.col("w.window").alias("window"), (F.col("w.hi") - F.col("w.lo")).alias("hours"))
    own = [*keys, "window", "hours"]
    held = merged(held, own)
    out = counters(held, own).select(*own, "cycles", "boarded", "alighted", "transfer_n", "transfer_mean").join(pool(held, own, "close").select(*own, "close_n", "close_median", "close_p85"), own, "left")
    rate = lambda c: F.col(c) / (F.col("hours") * max(1, n_days))
    out = out.withColumns({"close_n": F.coalesce("close_n", F.lit(0)), "cycles_per_hour": rate("cycles"), "boarded_per_hour": rate("boarded"), "alighted_per_hour": rate("alighted")})
    whole = out.where("window = 'all'").select(*keys, F.col("cycles_per_hour").alias("all_day"))
    return out.join(whole, keys).withColumn("ratio", F.when(F.col("all_day") > 0, F.col("cycles_per_hour") / F.col("all_day")).otherwise(1.0)).drop("all_day")
