"""Demand on the calendar of observed cells; the statements find outages by minutes and versions by look-up, the plans by declared expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import demand
from ..registry import query
from ..sources import adapters as a

CAMS = tuple(f"ch{c}" for c in a.CAMS)
P = demand.Period(CAMS, a.EPOCH - a.LOCAL_US, a.EPOCH - a.LOCAL_US + 31 * a.DAY_US, a.LOCAL_US)
H, D, S, T0, T1, L = demand.HOUR_US, demand.DAY_US, demand.SLOT_US, P.t0, P.t1, P.local_us


def version(cam: str, ts: str) -> str:
    return f"coalesce((SELECT v.version FROM epochs v WHERE (v.cam IS NULL OR v.cam = {cam}) AND v.from_us <= {ts} ORDER BY v.from_us DESC, v.cam NULLS LAST LIMIT 1), 'pre-declared')"


def gap(cam: str, ts: str) -> str:
    return f"EXISTS (SELECT 1 FROM gaps g WHERE (g.gap_cam IS NULL OR g.gap_cam = {cam}) AND {ts} >= g.start_us AND {ts} < g.end_us)"


def hour(ts: str) -> str:
    return f"(({ts} + {L}) // {H} * {H} - {L})"


def day(ts: str) -> str:
    return f"(({ts} + {L}) // {D})"


BASE = (
    a.ctes("door", "transit", "episode", "gaps", "epochs")
    + f""",
cams AS (SELECT unnest({list(CAMS)!r}) AS cam),
cal AS (SELECT cam, h, {version("x.cam", f"x.h + {H // 2}")} AS mid_version FROM (SELECT cam, unnest(range({T0}, {T1}, {H})) AS h FROM cams) x),
st AS (SELECT * FROM (SELECT cam, ts_us FROM door UNION ALL SELECT cam, ts_us FROM transit UNION ALL SELECT cam, start_us FROM episode) WHERE ts_us >= {T0} AND ts_us < {T1}),
sl AS (SELECT DISTINCT cam, (ts_us - {T0}) // {S} * {S} + {T0} AS s FROM st),
slots AS (SELECT *, {gap("sl.cam", f"s + {S // 2}")} AS gapped FROM sl),
obs AS (SELECT DISTINCT cam, {hour(f"(s + {S // 2})")} AS h FROM slots WHERE NOT gapped),
cross1 AS (SELECT cam, {hour("ts_us")} AS h, {version("t.cam", "t.ts_us")} AS version, CASE WHEN direction = 'in' THEN 1 ELSE 0 END AS i FROM transit t WHERE ts_us >= {T0} AND ts_us < {T1} AND NOT {gap("t.cam", "t.ts_us")}),
counted AS (SELECT h, cam, version, sum(i) AS boarded, sum(1 - i) AS alighted FROM cross1 GROUP BY ALL),
minutes AS (SELECT cam, m FROM (SELECT cam, unnest(range({T0}, {T1}, 60000000)) AS m FROM cams) x WHERE {gap("x.cam", "m")})"""
)


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, demand.Outages, DataFrame]:
    """transits, episodes, rows of all streams, outages, epochs."""
    t, e = a.transit(spark, sf_dir), a.episode(spark, sf_dir)
    streams = a.door(spark, sf_dir).select("cam", "ts_us").unionByName(t.select("cam", "ts_us")).unionByName(e.select("cam", F.col("start_us").alias("ts_us")))
    return t, e, streams, demand.Outages(a.gaps(spark), CAMS), a.version_epochs(spark)


@query(
    "ag10_demand_log",
    BASE + f""",
r AS (SELECT cal.h AS hour_us, cal.cam AS lift, coalesce(c.version, mid_version) AS version, o.h IS NOT NULL AS observed, c.boarded AS b, c.alighted AS al
  FROM cal LEFT JOIN obs o ON o.cam = cal.cam AND o.h = cal.h LEFT JOIN counted c ON c.cam = cal.cam AND c.h = cal.h),
f AS (SELECT hour_us, version, sum(coalesce(b, 0)) AS b, sum(coalesce(al, 0)) AS al, count(*) AS n FROM r WHERE observed GROUP BY ALL)
SELECT hour_us, lift, version, CAST(CASE WHEN observed THEN coalesce(b, 0) END AS BIGINT) AS boarded, CAST(CASE WHEN observed THEN coalesce(al, 0) END AS BIGINT) AS alighted, observed, CAST(NULL AS BIGINT) AS lifts FROM r
UNION ALL SELECT hour_us, 'FLEET', version, CAST(b AS BIGINT), CAST(al AS BIGINT), true, n FROM f
UNION ALL SELECT h, 'FLEET', mid_version, NULL, NULL, false, 0 FROM cal WHERE cam = 'ch16' AND h NOT IN (SELECT hour_us FROM f)""",
)
def ag10_demand_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour and lift of the period, dark ones with nulls, and the fleet by version."""
    t, _, streams, out, epochs = _parts(spark, sf_dir)
    return demand.hourly_log(t, streams, P, out, epochs)


@query(
    "ag10_daily_log",
    BASE + f""",
u AS (SELECT {day("h")} AS day, cam, h, NOT {gap("cal.cam", f"h + {H // 2}")} AS usable FROM cal),
d AS (SELECT day, u.cam, count(*) FILTER (usable) AS usable_hours, count(o.h) FILTER (usable) AS hours_observed FROM u LEFT JOIN obs o ON o.cam = u.cam AND o.h = u.h GROUP BY ALL),
c AS (SELECT {day("h")} AS day, cam, version, sum(boarded) AS b, sum(alighted) AS al FROM counted GROUP BY ALL)
SELECT d.day, d.cam, coalesce(c.version, {version("d.cam", f"(d.day * {D} - {L} + {12 * H})")}) AS version, CAST(coalesce(b, 0) AS BIGINT) AS boarded, CAST(coalesce(al, 0) AS BIGINT) AS alighted, hours_observed, usable_hours,
  CASE WHEN usable_hours > 0 THEN 100.0::DOUBLE * hours_observed / usable_hours END AS coverage_pct
FROM d LEFT JOIN c ON c.day = d.day AND c.cam = d.cam WHERE c.version IS NOT NULL OR hours_observed > 0""",
)
def ag10_daily_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _, streams, out, epochs = _parts(spark, sf_dir)
    return demand.daily_log(t, streams, P, out, epochs)


@query(
    "ag26_coverage_pct",
    BASE + f""",
days AS (SELECT DISTINCT {day("h")} AS day, cam FROM cal),
have AS (SELECT {day("s")} AS day, cam, count(*) AS n FROM slots WHERE NOT gapped GROUP BY ALL),
gone AS (SELECT {day("m")} AS day, cam, count(*) AS n FROM minutes GROUP BY ALL),
x AS (
  SELECT d.day, d.cam, greatest(0, 96 - coalesce(gone.n, 0) // 15) AS usable, coalesce(have.n, 0) AS observed FROM days d LEFT JOIN have USING (day, cam) LEFT JOIN gone USING (day, cam)
  UNION ALL SELECT NULL, cam, greatest(1, {(T1 - T0) // S} - (SELECT count(*) FROM minutes m WHERE m.cam = cams.cam) // 15), (SELECT coalesce(sum(n), 0) FROM have h WHERE h.cam = cams.cam) FROM cams)
SELECT day, cam, CAST(usable AS BIGINT) AS usable, CAST(observed AS BIGINT) AS observed, CASE WHEN usable > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * observed / usable) END AS coverage_pct FROM x""",
)
def ag26_coverage_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day and (day null) for the whole period."""
    _, _, streams, out, _ = _parts(spark, sf_dir)
    return demand.coverage(streams, P, out)


MEANS = f"""{BASE},
live AS (
  SELECT cal.cam, cal.h, mid_version AS version FROM cal WHERE EXISTS (SELECT 1 FROM slots WHERE slots.cam = cal.cam AND {hour("slots.s")} = cal.h)
    AND (SELECT count(*) FROM minutes m WHERE m.cam = cal.cam AND m.m >= cal.h AND m.m < cal.h + {H}) < 60),
both_ AS (SELECT h, cam, version, boarded AS b, alighted AS al FROM counted
  UNION ALL SELECT {hour("e.start_us")}, cam, {version("e.cam", "e.start_us")}, machine_boarded, machine_alighted FROM episode e WHERE start_us >= {T0} AND start_us < {T1} AND NOT {gap("e.cam", "e.start_us")}),
k AS (SELECT l.version, l.cam, l.h, coalesce(sum(b), 0) AS b, coalesce(sum(al), 0) AS al FROM live l LEFT JOIN both_ USING (h, cam, version) GROUP BY ALL),
s AS (SELECT version, cam AS lift, (h + {L}) // {H} % 24 AS hour, count(*) AS n, sum(b) AS b, sum(al) AS al FROM k GROUP BY ALL),
grid AS (SELECT version, cam AS lift, hour FROM (SELECT DISTINCT mid_version AS version FROM cal), cams, (SELECT unnest(range(24)) AS hour)),
means AS (
  SELECT version, lift, hour, coalesce(n, 0) AS observed_days, b AS boarded, al AS alighted, CAST(b AS DOUBLE) / n AS mean_boarded, CAST(al AS DOUBLE) / n AS mean_alighted, CAST(NULL AS BIGINT) AS lifts FROM grid LEFT JOIN s USING (version, lift, hour)),
whole AS (SELECT * FROM means UNION ALL SELECT version, 'FLEET', hour, sum(observed_days), sum(boarded), sum(alighted), sum(mean_boarded), sum(mean_alighted), count(mean_boarded) FROM means GROUP BY version, hour)"""


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e, streams, out, epochs = _parts(spark, sf_dir)
    return demand.hour_means(t, e, streams, P, out, epochs)


@query(
    "ag4_observed_hour_means",
    MEANS + " SELECT version, lift, CAST(hour AS BIGINT) AS hour, CAST(observed_days AS BIGINT) AS observed_days, CAST(boarded AS BIGINT) AS boarded, CAST(alighted AS BIGINT) AS alighted, mean_boarded, mean_alighted, lifts FROM whole",
)
def ag4_observed_hour_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir)


@query(
    "ag4_peak_hour",
    MEANS + """,
top AS (SELECT *, row_number() OVER (PARTITION BY version, lift ORDER BY mean_boarded DESC, hour) AS r, avg(mean_boarded) OVER (PARTITION BY version, lift) AS m, count(*) OVER (PARTITION BY version, lift) AS c FROM whole WHERE mean_boarded IS NOT NULL)
SELECT w.version, w.lift, CAST(CASE WHEN mean_boarded > 0 THEN hour END AS BIGINT) AS hour, CASE WHEN mean_boarded > 0 THEN mean_boarded END AS value, CASE WHEN mean_boarded > 0 THEN m END AS mean,
  CASE WHEN mean_boarded > 0 THEN mean_boarded / m END AS ratio, coalesce(c, 0) AS n_hours FROM (SELECT DISTINCT version, lift FROM whole) w LEFT JOIN top ON top.version = w.version AND top.lift = w.lift AND r = 1""",
)
def ag4_peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.peaks(_means(spark, sf_dir))


@query(
    "ag4_load_balance",
    MEANS + " SELECT version, CAST(hour AS BIGINT) AS hour, count(mean_boarded) AS lifts, CASE WHEN count(mean_boarded) >= 3 AND avg(mean_boarded) > 0 THEN stddev_samp(mean_boarded) / avg(mean_boarded) END AS cv FROM means GROUP BY version, hour",
)
def ag4_load_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand.load_balance(_means(spark, sf_dir))


@query(
    "ag9_day_lift_matrix",
    BASE + f""",
seen AS (SELECT DISTINCT {day("ts_us")} AS day, cam FROM st WHERE NOT {gap("st.cam", "st.ts_us")}),
n AS (SELECT {day("h")} AS day, cam, sum(boarded) AS b, sum(alighted) AS al FROM counted GROUP BY ALL),
direct AS (SELECT {day("start_us")} AS day, cam, list_sort(list(DISTINCT counting_version)) AS vs FROM episode GROUP BY ALL),
cells AS (
  SELECT d.day, c.cam, s.day IS NOT NULL AS seen, coalesce(b, 0) AS b, coalesce(al, 0) AS al, vs, CASE WHEN vs IS NULL THEN {version("c.cam", f"(d.day * {D} - {L} + {12 * H})")} WHEN len(vs) = 1 THEN vs[1] END AS version,
    {version("c.cam", str(T1))} AS now
  FROM (SELECT DISTINCT day FROM seen) d, cams c LEFT JOIN seen s ON s.day = d.day AND s.cam = c.cam LEFT JOIN n ON n.day = d.day AND n.cam = c.cam LEFT JOIN direct x ON x.day = d.day AND x.cam = c.cam)
SELECT day, cam, CAST(CASE WHEN seen THEN b END AS BIGINT) AS boarded, CAST(CASE WHEN seen THEN al END AS BIGINT) AS alighted, CAST(CASE WHEN seen THEN b + al END AS BIGINT) AS riders, CASE WHEN seen THEN 0 ELSE 1 END::BIGINT AS dark, version,
  CASE WHEN vs IS NULL THEN 'declared' ELSE 'episodes' END AS source, coalesce(len(vs) > 1, false) AS mixed, CASE WHEN seen THEN coalesce(version <> now, false) END AS off_era FROM cells
UNION ALL
SELECT day, cam, CAST(sum(b) FILTER (seen) AS BIGINT), CAST(sum(al) FILTER (seen) AS BIGINT), CAST(sum(b + al) FILTER (seen) AS BIGINT), count(*) FILTER (NOT seen), NULL, NULL, NULL, NULL FROM cells GROUP BY GROUPING SETS ((day), (cam), ())""",
)
def ag9_day_lift_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, e, streams, out, epochs = _parts(spark, sf_dir)
    current = demand.versioned(spark.createDataFrame([(c,) for c in CAMS], "cam string"), F.lit(P.t1), epochs).select("cam", "version")
    return demand.day_matrix(t, e, streams, P, out, epochs, current)
