"""Cycle figures, windows of the day and their stored partials; the statements compute each from the cycles themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import demand, joins, partials
from ..registry import query
from ..sources import adapters as a
from ..sources import sinks
from .demand import CAMS, P, gap
from .sequences import FLAP_CYCLES, HOUR_US, _flap_cycles

#: The driver's pace: seconds a person, and the line that closings are held against.
PER_PERSON, CLIFF = 450.0, 10.0
Z = stats.Z95
WINDOWS = {"am": (8, 10), "pm": (18, 20), "all": (0, 24), "custom": (12, 15)}
DAYS = (P.t1 - P.t0) // demand.DAY_US


def boarded_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles with who got in and out between opening and close; null where the start wasn't seen."""
    c = _flap_cycles(spark, sf_dir)
    keyed = c.where("ts_us IS NOT NULL").select("cam", "door_version", "close_us", F.col("ts_us").alias("lo_us"))
    pairs = joins.point_in_interval(a.transit(spark, sf_dir), keyed, "lo_us", "close_us", 6 * HOUR_US)
    into = F.coalesce(F.col("p.direction") == "in", F.lit(False))
    load = pairs.groupBy(*[F.col(f"i.{k}").alias(k) for k in ("cam", "door_version", "close_us")]).agg(F.count_if(into).alias("b"), F.count_if(~into).alias("al"))
    known = F.col("ts_us").isNotNull()
    return c.join(load, ["cam", "door_version", "close_us"], "left").select(*c.columns, F.when(known, F.coalesce("b", F.lit(0))).alias("boarded"), F.when(known, F.coalesce("al", F.lit(0))).alias("alighted"))


def _outages(spark: SparkSession) -> demand.Outages:
    return demand.Outages(a.gaps(spark), CAMS)


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partials.partials(boarded_cycles(spark, sf_dir), _outages(spark), a.LOCAL_US, per_person=PER_PERSON)


CYCLES = (
    a.ctes("door", "transit", "gaps")
    + ","
    + FLAP_CYCLES
    + f""",
bc AS (SELECT fc.*, coalesce(ts_us, close_us) AS seen_us, CASE WHEN ts_us IS NOT NULL THEN (SELECT count(*) FILTER (t.direction = 'in') FROM transit t WHERE t.cam = fc.cam AND t.ts_us BETWEEN fc.ts_us AND fc.close_us) END AS boarded,
  CASE WHEN ts_us IS NOT NULL THEN (SELECT count(*) FILTER (t.direction IS DISTINCT FROM 'in') FROM transit t WHERE t.cam = fc.cam AND t.ts_us BETWEEN fc.ts_us AND fc.close_us) END AS alighted FROM fc),
c AS (SELECT *, {gap("bc.cam", "bc.seen_us")} AS gapped, class = 'clean' AS clean, boarded + alighted AS load, (seen_us + {a.LOCAL_US}) // 3600000000 % 24 AS hour FROM bc),
free AS (SELECT * FROM c WHERE NOT gapped)"""
)


def _rank(lst: str, q: float) -> str:
    return f"{lst}[least(len({lst}), CAST(floor({q} * len({lst})) AS BIGINT) + 1)]"


def _figures(kind: str, lst: str, edges: tuple = ()) -> str:
    n = f"len({lst})"
    mean, sd = f"list_avg({lst})", f"list_stddev_samp({lst})"
    out = f"""CAST(coalesce({n}, 0) AS BIGINT) AS {kind}_n, {_rank(lst, 0.5)} AS {kind}_median, {_rank(lst, 0.85)} AS {kind}_p85,
      CASE WHEN {n} >= 6 THEN {lst}[CAST(greatest(1, floor({n} / 2.0 - {Z} * sqrt({n}) / 2)) AS BIGINT)] END AS {kind}_median_lo, CASE WHEN {n} >= 6 THEN {lst}[CAST(least({n}, ceil(1 + {n} / 2.0 + {Z} * sqrt({n}) / 2)) AS BIGINT)] END AS {kind}_median_hi,
      list_min({lst}) AS {kind}_least, list_max({lst}) AS {kind}_most, {mean} AS {kind}_mean, CASE WHEN {n} > 1 THEN {mean} - {Z} * {sd} / sqrt({n}) END AS {kind}_mean_lo, CASE WHEN {n} > 1 THEN {mean} + {Z} * {sd} / sqrt({n}) END AS {kind}_mean_hi"""
    if edges:
        bounds = list(zip([-1e300, *edges], [*edges, 1e300]))
        out += f", CASE WHEN {n} > 0 THEN [{', '.join(f'CAST(len(list_filter({lst}, lambda x: x >= {lo} AND x < {hi})) AS BIGINT)' for lo, hi in bounds)}] END AS {kind}_hist"
    return out


def _sum(kind: str, value: str, when: str) -> str:
    return f"count(*) FILTER ({when}) AS {kind}_n, avg({value}) FILTER ({when}) AS {kind}_m, stddev_samp({value}) FILTER ({when}) AS {kind}_sd"


def _sum_out(kind: str) -> str:
    return f"{kind}_n, {kind}_m AS {kind}_mean, CASE WHEN {kind}_n > 1 THEN {kind}_m - {Z} * {kind}_sd / sqrt({kind}_n) END AS {kind}_mean_lo, CASE WHEN {kind}_n > 1 THEN {kind}_m + {Z} * {kind}_sd / sqrt({kind}_n) END AS {kind}_mean_hi"


SUMMARY = f"""{CYCLES},
g AS (SELECT cam, door_version, count(*) FILTER (gapped) AS in_gap FROM c GROUP BY 1, 2),
p AS (
  SELECT cam, door_version, count(*) AS cycles, count(*) FILTER (NOT clean) AS excluded, count(*) FILTER (clean AND close_travel_s < 0.5) AS floor_rejected, count(boarded) AS counted, sum(boarded) AS boarded, sum(alighted) AS alighted, min(seen_us) AS first_us, max(seen_us) AS last_us,
    list_sort(list(close_travel_s) FILTER (clean AND close_travel_s >= 0.5)) AS lc, list_sort(list(close_travel_s) FILTER (clean)) AS lp, list_sort(list(dwell_s) FILTER (dwell_s > 0)) AS ld, list_sort(list(open_travel_s) FILTER (open_travel_s > 0)) AS lo_,
    {_sum("transfer", "dwell_s / load", "load > 0 AND dwell_s > 0")}, {_sum("lost", f"dwell_s - {PER_PERSON} * load", "load > 0 AND dwell_s > 0")}, {_sum("pax", "boarded", "boarded IS NOT NULL")}
  FROM free GROUP BY 1, 2),
f AS (
  SELECT cam, door_version, coalesce(cycles, 0) AS cycles, in_gap, coalesce(excluded, 0) AS excluded, coalesce(floor_rejected, 0) AS floor_rejected, coalesce(counted, 0) AS counted, CAST(coalesce(boarded, 0) AS BIGINT) AS boarded, CAST(coalesce(alighted, 0) AS BIGINT) AS alighted, first_us, last_us,
    {_figures("close", "lc", partials.CLOSE_EDGES)}, CAST(coalesce(len(lp), 0) AS BIGINT) AS prefilter_n, {_rank("lp", 0.5)} AS prefilter_median, {_rank("lp", 0.85)} AS prefilter_p85, {_figures("dwell", "ld", partials.DWELL_EDGES)}, {_figures("open", "lo_")},
    {_sum_out("transfer")}, {_sum_out("lost")}, {_sum_out("pax")}, CASE WHEN len(lc) > 0 THEN CAST(len(list_filter(lc, lambda x: x > {CLIFF})) AS BIGINT) END AS over FROM g LEFT JOIN p USING (cam, door_version)),
w AS (SELECT *, CAST(over AS DOUBLE) / nullif(close_n, 0) AS sh, {Z * Z} AS z2 FROM f)
SELECT * EXCLUDE (sh, z2), 100.0 * sh AS over_pct, CASE WHEN close_n > 0 THEN greatest(0.0, 100 * (sh + z2 / (2 * close_n) - {Z} * sqrt(sh * (1 - sh) / close_n + z2 / (4.0 * close_n * close_n))) / (1 + z2 / close_n)) END AS over_lo,
  CASE WHEN close_n > 0 THEN least(100.0, 100 * (sh + z2 / (2 * close_n) + {Z} * sqrt(sh * (1 - sh) / close_n + z2 / (4.0 * close_n * close_n))) / (1 + z2 / close_n)) END AS over_hi,
  CAST(floor_rejected AS DOUBLE) / nullif(prefilter_n, 0) AS floor_reject_share, coalesce(CAST(floor_rejected AS DOUBLE) / nullif(prefilter_n, 0) > {partials.WARN}, false) AS floor_reject_warn,
  CASE WHEN covered_s > 0 THEN cycles / (covered_s / 3600) END AS cycles_per_hour
FROM w JOIN (SELECT cam, ({P.t1 - P.t0} - 60000000 * (SELECT count(*) FROM (SELECT unnest(range({P.t0}, {P.t1}, 60000000)) AS m) WHERE {gap("x.cam", "m")})) / 1000000.0::DOUBLE AS covered_s FROM (SELECT DISTINCT cam FROM door) x) USING (cam)"""


@query("ag1_cycle_summary", SUMMARY)
def ag1_cycle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of each lift and era."""
    return partials.with_rate(partials.summary(_partials(spark, sf_dir), partials.ERA, CLIFF), _outages(spark), P.t0, P.t1)


@query("ag1_resolution")
def ag1_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampling quantum of each era and the pools that it makes unreadable."""
    return partials.resolution(_partials(spark, sf_dir), partials.ERA)


PROFILE = f"""{CYCLES},
win AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {lo}, {hi})" for n, (lo, hi) in WINDOWS.items())}) t(win, lo, hi)),
p AS (
  SELECT cam, door_version, win, hi - lo AS hours, count(*) FILTER (NOT gapped) AS cycles, CAST(coalesce(sum(boarded) FILTER (NOT gapped), 0) AS BIGINT) AS boarded, CAST(coalesce(sum(alighted) FILTER (NOT gapped), 0) AS BIGINT) AS alighted,
    count(*) FILTER (NOT gapped AND load > 0 AND dwell_s > 0) AS transfer_n, avg(dwell_s / load) FILTER (NOT gapped AND load > 0 AND dwell_s > 0) AS transfer_mean, list_sort(list(close_travel_s) FILTER (NOT gapped AND clean AND close_travel_s >= 0.5)) AS l
  FROM c JOIN win ON c.hour >= lo AND c.hour < hi GROUP BY ALL)
SELECT p.cam, p.door_version, p.win AS window, p.hours, p.cycles, p.boarded, p.alighted, p.transfer_n, p.transfer_mean, CAST(coalesce(len(p.l), 0) AS BIGINT) AS close_n, {_rank("p.l", 0.5)} AS close_median, {_rank("p.l", 0.85)} AS close_p85,
  p.cycles / (p.hours * {DAYS}.0) AS cycles_per_hour, p.boarded / (p.hours * {DAYS}.0) AS boarded_per_hour, p.alighted / (p.hours * {DAYS}.0) AS alighted_per_hour,
  CASE WHEN w.cycles > 0 THEN (p.cycles / (p.hours * {DAYS}.0)) / (w.cycles / (24 * {DAYS}.0)) ELSE 1.0 END AS ratio
FROM p JOIN p w ON w.cam = p.cam AND w.door_version = p.door_version AND w.win = 'all'"""


@query("ag11_window_profile", PROFILE)
def ag11_window_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morning, evening, all day and a window of one's own, by lift and era."""
    return partials.profile(_partials(spark, sf_dir), partials.ERA, WINDOWS, DAYS)


@query(
    "ag11_hour_profile",
    CYCLES + f""" SELECT cam, hour, count(*) FILTER (NOT gapped) AS cycles, CAST(coalesce(sum(boarded) FILTER (NOT gapped), 0) AS BIGINT) AS boarded, CAST(coalesce(sum(alighted) FILTER (NOT gapped), 0) AS BIGINT) AS alighted,
    CAST(coalesce(len(list(close_travel_s) FILTER (NOT gapped AND clean AND close_travel_s >= 0.5)), 0) AS BIGINT) AS close_n, list_sort(list(close_travel_s) FILTER (NOT gapped AND clean AND close_travel_s >= 0.5)) AS l FROM c GROUP BY 1, 2""".replace("SELECT cam, hour", f"SELECT cam, hour, cycles, boarded, alighted, close_n, {_rank('l', 0.5)} AS close_median, {_rank('l', 0.85)} AS close_p85 FROM (SELECT cam, hour", 1) + ")",
)
def ag11_hour_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 24 hours of each lift, eras of one instrument's clock apart only in ag11_window_profile."""
    rows, keys = partials.merged(_partials(spark, sf_dir), ["cam", "hour"]), ["cam", "hour"]
    close = partials.pool(rows, keys, "close").select(*keys, "close_n", "close_median", "close_p85")
    return partials.counters(rows, keys).select(*keys, "cycles", "boarded", "alighted").join(close, keys, "left").withColumn("close_n", F.coalesce("close_n", F.lit(0)))


@query(
    "sk13_stored_partials",
    CYCLES + f" SELECT cam, door_version, (seen_us + {a.LOCAL_US}) // {7 * demand.DAY_US} AS week, count(*) FILTER (NOT gapped) AS cycles, count(*) FILTER (gapped) AS in_gap FROM c GROUP BY 1, 2, 3",
)
def sk13_stored_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks folded from stored partials: twenty days are stored first, then the rest of them, which rewrites only what changed."""
    c, out = boarded_cycles(spark, sf_dir), _outages(spark)
    at, path = F.coalesce("ts_us", "close_us"), f"{sinks.shared_dir(spark)}/partials-{uuid.uuid4().hex}"
    partials.refresh(c.where(at < a.EPOCH + 20 * a.DAY_US), path, out, a.LOCAL_US, 1.0, PER_PERSON)
    partials.refresh(c, path, out, a.LOCAL_US, 2.0, PER_PERSON)
    rows = partials.merged(partials.stored_partials(spark, path).withColumn("week", F.floor(F.col("day") / 7)), ["cam", "door_version", "week"])
    return partials.counters(rows, ["cam", "door_version", "week"]).select("cam", "door_version", "week", "cycles", "in_gap")
