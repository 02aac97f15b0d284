"""Queries over ordered streams: DataFrame operators with a DuckDB twin for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import carry, cycles, joins, leftovers
from ..registry import query
from ..sources import adapters as a

US = 1_000_000
HOUR_US = 3600 * US
LOCAL_HOUR = "CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24"


def nr(q: float, value: str = "v") -> str:
    """Nearest rank in DuckDB over list l of values."""
    return f"l[least(len(l), CAST(floor({q} * len(l)) AS BIGINT) + 1)]"


STATE_CYCLES = """cyc AS (SELECT cam, door_version, ts_us, id FROM (SELECT *, lag(door_state) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id) AS prev FROM door)
  WHERE door_state = 'closed' AND prev IN ('closing', 'open'))"""


@query(
    "wn4_state_cycles_by_hour",
    a.ctes("door")
    + f""", {STATE_CYCLES},
    g AS (SELECT cam, {LOCAL_HOUR} AS hour, (ts_us - lag(ts_us) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id)) / 1000000.0 AS gap FROM cyc),
    s AS (SELECT cam, hour, count(*) AS cycles, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS l FROM g GROUP BY 1, 2)
    SELECT cam, hour, cycles, {nr(0.5)} AS median_gap_s FROM s""",
)
def wn4_state_cycles_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cycles.gaps_s(cycles.state_only_cycles(a.door(spark, sf_dir)))
    g = c.select("cam", cycles.labelled_local_hour(F.col("ts_us")).alias("hour"), "gap")
    middle = stats.ranked(g, ["cam", "hour"], "gap").groupBy("cam", "hour").agg(stats.nearest_rank(0.5).alias("median_gap_s"))
    return g.groupBy("cam", "hour").agg(F.count("*").alias("cycles")).join(middle, ["cam", "hour"], "left")


FLAP_CYCLES = """
r0 AS (SELECT *, CASE WHEN door_state IS DISTINCT FROM lag(door_state) OVER w THEN 1 ELSE 0 END AS new FROM door WHERE door_state IS NOT NULL WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id)),
r1 AS (SELECT *, sum(new) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id) AS run FROM r0),
r2 AS (SELECT cam, door_version, run, door_state AS s, min(ts_us) AS t, arg_min(close_travel_s, ts_us) FILTER (WHERE close_travel_s IS NOT NULL) AS ct, arg_min(floor, ts_us) FILTER (WHERE floor IS NOT NULL) AS fl FROM r1 GROUP BY 1, 2, 3, 4),
r3 AS (SELECT *, lag(s) OVER w AS p, lag(t) OVER w AS pt, lag(ct) OVER w AS pct FROM r2 WINDOW w AS (PARTITION BY cam, door_version ORDER BY run)),
r4 AS (SELECT *, coalesce(s = 'opening' AND p = 'closed', false) AS rb, coalesce(s = 'closed' AND p = 'closing', false) AS ra FROM r3),
r5 AS (SELECT *, sum(CAST(rb AS INT)) OVER w + coalesce(sum(CAST(ra AS INT)) OVER (PARTITION BY cam, door_version ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
  last_value(CASE WHEN rb THEN t END IGNORE NULLS) OVER w AS opg FROM r4 WINDOW w AS (PARTITION BY cam, door_version ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
segs AS (SELECT cam, door_version, seg,
  bool_or(coalesce((s = 'open' AND p = 'closing' AND (t - pt) / 1e6 < 300) OR (s = 'closing' AND p = 'open' AND (t - pt) / 1e6 < 450), false)) AS flap,
  bool_or(coalesce(s = 'open' AND p = 'closing' AND (t - pt) / 1e6 >= 300, false)) AS reopened,
  arg_max((t - pt) / 1e6, run) FILTER (WHERE s = 'closing' AND p = 'open') AS dwell_s, arg_max((t - opg) / 1e6, run) FILTER (WHERE s = 'open' AND p = 'opening') AS open_travel_s,
  arg_min(t, run) FILTER (WHERE rb OR s = 'open') AS ts_us, arg_min(fl, run) FILTER (WHERE s = 'open' AND fl IS NOT NULL) AS floor, max(t) FILTER (WHERE ra) AS close_us, max(coalesce(pct, ct)) FILTER (WHERE ra) AS close_travel_s
  FROM r5 GROUP BY 1, 2, 3),
fc AS (SELECT cam, door_version, ts_us, close_us, floor, dwell_s, open_travel_s, close_travel_s,
  CASE WHEN flap THEN 'flap' WHEN reopened THEN 'reopened' WHEN NOT close_travel_s BETWEEN 0.3 AND 30 THEN 'implausible' ELSE 'clean' END AS class FROM segs WHERE close_us IS NOT NULL AND close_travel_s > 0)"""


def _flap_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.flap_aware_cycles(a.door(spark, sf_dir), cycles.DRIVER)


query("wn2_flap_aware_cycles", a.ctes("door") + "," + FLAP_CYCLES + " SELECT * FROM fc")(_flap_cycles)


TRIPS = f"""{STATE_CYCLES},
d AS (SELECT door.*, CASE WHEN cyc.id IS NOT NULL THEN 1 ELSE 0 END AS close, CASE WHEN door_state = 'open' AND coalesce(lag(door_state) OVER (PARTITION BY door.cam, door.door_version ORDER BY door.ts_us, door.id), '') <> 'open' THEN 1 ELSE 0 END AS opens FROM door LEFT JOIN cyc ON cyc.id = door.id),
d1 AS (SELECT *, coalesce(sum(close) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM d),
d2 AS (SELECT *, last_value(floor IGNORE NULLS) OVER (PARTITION BY cam, door_version, part ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cf,
  last_value(floor IGNORE NULLS) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opf, sum(close) OVER (PARTITION BY cam, door_version ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closes FROM d1),
o AS (SELECT cam, door_version, ts_us AS back_us, closes AS back_closes FROM d2 WHERE opens = 1 AND opf = 'G'),
trips AS (SELECT c.cam, c.door_version, c.ts_us, o.back_us, (o.back_us - c.ts_us) / 1000000.0 AS rtt_s, CAST(o.back_closes - c.closes AS BIGINT) AS n_stops FROM (SELECT * FROM d2 WHERE close = 1 AND cf = 'G') c
  ASOF JOIN o ON c.cam = o.cam AND c.door_version = o.door_version AND c.ts_us < o.back_us)"""


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.round_trips(a.door(spark, sf_dir), "G")


query("wn6_round_trips", a.ctes("door") + ", " + TRIPS + " SELECT * FROM trips")(_trips)


@query(
    "ag12_rtt_summary",
    a.ctes("door")
    + ", "
    + TRIPS
    + f""", t AS (SELECT cam, door_version, count(*) AS trips, count(*) FILTER (WHERE rtt_s < 9000) AS short, count(*) FILTER (WHERE rtt_s > 180000) AS long, list_sort(list(rtt_s) FILTER (WHERE rtt_s BETWEEN 9000 AND 180000)) AS l, median(rtt_s) FILTER (WHERE rtt_s BETWEEN 9000 AND 180000) AS m FROM trips GROUP BY 1, 2)
    SELECT cam, door_version, trips, short, long, round(m, 4) AS median_s, {nr(0.85)} AS p85_s FROM t""",
)
def ag12_rtt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trips(spark, sf_dir)
    ok = F.col("rtt_s").between(9000, 180000)
    head = t.groupBy(*cycles.ERA).agg(F.count("*").alias("trips"), F.count_if(F.col("rtt_s") < 9000).alias("short"), F.count_if(F.col("rtt_s") > 180000).alias("long"))
    middle = stats.ranked(t.where(ok), cycles.ERA, "rtt_s").groupBy(*cycles.ERA).agg(F.round(stats.linear(0.5), 4).alias("median_s"), stats.nearest_rank(0.85).alias("p85_s"))
    return head.join(middle, cycles.ERA, "left")


STOPS = """
w0 AS (SELECT *, floor IS NOT NULL AND reason IN ('ok', 'single_panel') AS sure, last_value(door_state IGNORE NULLS) OVER (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM door),
w1 AS (SELECT *, first_value(CASE WHEN door_state = 'closed' THEN ts_us END IGNORE NULLS) OVER a AS shut, first_value(CASE WHEN sure THEN ts_us END IGNORE NULLS) OVER a AS nt, first_value(CASE WHEN sure THEN floor END IGNORE NULLS) OVER a AS nf,
  last_value(CASE WHEN sure THEN ts_us END IGNORE NULLS) OVER b AS lt, last_value(CASE WHEN sure THEN floor END IGNORE NULLS) OVER b AS lf FROM w0
  WINDOW a AS (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), b AS (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w2 AS (SELECT *, CASE WHEN shut - ts_us <= 18000000000 THEN shut ELSE ts_us + 18000000000 END AS close_us FROM w1 WHERE door_state IN ('opening', 'open') AND NOT coalesce(known, '') IN ('opening', 'open')),
w3 AS (SELECT *, CASE WHEN sure THEN ts_us WHEN nt <= close_us AND nt - ts_us <= 18000000000 THEN nt ELSE lt END AS st, CASE WHEN sure THEN floor WHEN nt <= close_us AND nt - ts_us <= 18000000000 THEN nf ELSE lf END AS sf FROM w2),
stops AS (SELECT cam, id, ts_us, close_us, CASE WHEN abs(st - ts_us) <= 3000000000 THEN sf END AS floor FROM w3)"""


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles.stops(a.door(spark, sf_dir), cycles.DRIVER)


query("wn13_stops", a.ctes("door") + "," + STOPS + " SELECT * FROM stops")(_stops)


@query(
    "jn4_stop_transits",
    a.ctes("door", "transit") + "," + STOPS + """ SELECT s.cam, s.floor, count(*) AS n, count(*) FILTER (WHERE t.direction = 'in') AS boarded, count(DISTINCT s.id) AS stops FROM stops s JOIN transit t ON t.cam = s.cam AND t.ts_us BETWEEN s.ts_us AND s.close_us GROUP BY 1, 2""",
)
def jn4_stop_transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _stops(spark, sf_dir).withColumnsRenamed({"ts_us": "lo_us", "id": "stop_id"})
    pairs = joins.point_in_interval(a.transit(spark, sf_dir), s, "lo_us", "close_us", 6 * HOUR_US)
    return pairs.groupBy("i.cam", "i.floor").agg(F.count("*").alias("n"), F.count_if(F.col("p.direction") == "in").alias("boarded"), F.countDistinct("i.stop_id").alias("stops"))


@query(
    "jn2_transit_in_cycle",
    a.ctes("door", "transit") + "," + FLAP_CYCLES + """ SELECT t.id, t.cam, count(c.ts_us) AS cycles, count(c.ts_us) > 0 AS in_cycle, coalesce(arg_min(c.floor, c.ts_us) FILTER (WHERE c.floor IS NOT NULL AND c.ts_us IS NOT NULL), NULL) AS floor
    FROM transit t LEFT JOIN fc c ON c.cam = t.cam AND t.ts_us BETWEEN c.ts_us AND c.close_us GROUP BY 1, 2""",
)
def jn2_transit_in_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _flap_cycles(spark, sf_dir).where("ts_us IS NOT NULL").select("cam", F.col("ts_us").alias("lo_us"), "close_us", "floor")
    pairs = joins.point_in_interval(a.transit(spark, sf_dir), c, "lo_us", "close_us", 6 * HOUR_US, "left")
    return pairs.groupBy("p.id", "p.cam").agg(F.count("i.lo_us").alias("cycles"), (F.count("i.lo_us") > 0).alias("in_cycle"), F.min_by("i.floor", F.when(F.col("i.floor").isNotNull(), F.col("i.lo_us"))).alias("floor"))


@query(
    "jn3_floor_demand",
    a.ctes("door", "transit") + "," + FLAP_CYCLES + """, j AS (SELECT c.cam, c.door_version, c.floor, t.direction FROM fc c JOIN transit t ON c.cam = t.cam AND t.ts_us BETWEEN c.ts_us AND c.close_us WHERE c.floor IS NOT NULL),
    n AS (SELECT cam, count(*) AS total FROM transit GROUP BY cam)
    SELECT j.cam, j.door_version, j.floor, count(*) FILTER (WHERE direction = 'in') AS boarded, count(*) FILTER (WHERE direction IS DISTINCT FROM 'in') AS alighted, n.total AS n_transits_total FROM j JOIN n ON n.cam = j.cam GROUP BY 1, 2, 3, 6""",
)
def jn3_floor_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.transit(spark, sf_dir)
    c = _flap_cycles(spark, sf_dir).where("floor IS NOT NULL AND ts_us IS NOT NULL").withColumnRenamed("ts_us", "lo_us")
    pairs = joins.point_in_interval(t, c, "lo_us", "close_us", 6 * HOUR_US)
    by = pairs.groupBy("i.cam", "i.door_version", "i.floor").agg(F.count_if(F.col("p.direction") == "in").alias("boarded"), F.count_if(~(F.col("p.direction").eqNullSafe("in"))).alias("alighted"))
    return by.join(t.groupBy("cam").agg(F.count("*").alias("n_transits_total")), "cam")


@query(
    "jn5_newest_interval_wins",
    a.ctes("episode", "transit") + """, j AS (SELECT t.id AS transit_id, e.id AS episode_id, t.direction, row_number() OVER (PARTITION BY t.id ORDER BY e.id DESC) AS rn FROM transit t JOIN episode e ON e.cam = t.cam AND t.ts_us BETWEEN e.start_us - 1500000000 AND e.end_us + 7500000000)
    SELECT episode_id, count(*) FILTER (WHERE direction = 'in') AS boarded, count(*) FILTER (WHERE direction = 'out') AS alighted FROM j WHERE rn = 1 GROUP BY 1""",
)
def jn5_newest_interval_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", F.col("id").alias("episode_id"), (F.col("start_us") - 1500 * US).alias("lo_us"), (F.col("end_us") + 7500 * US).alias("hi_us"))
    best = joins.point_in_interval(a.transit(spark, sf_dir), e, "lo_us", "hi_us", 6 * HOUR_US).groupBy("p.id", "p.direction").agg(F.max("i.episode_id").alias("episode_id"))
    return best.groupBy("episode_id").agg(F.count_if(F.col("direction") == "in").alias("boarded"), F.count_if(F.col("direction") == "out").alias("alighted"))


@query(
    "jn6_first_interval_orphans",
    a.ctes("episode", "transit") + """, j AS (SELECT t.id, min(e.id) AS episode_id FROM transit t LEFT JOIN episode e ON e.cam = t.cam AND t.ts_us BETWEEN e.start_us - 600000000 AND e.end_us + 600000000 GROUP BY 1)
    SELECT id, episode_id, episode_id IS NULL AS orphan FROM j""",
)
def jn6_first_interval_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", F.col("id").alias("episode_id"), (F.col("start_us") - 600 * US).alias("lo_us"), (F.col("end_us") + 600 * US).alias("hi_us"))
    pairs = joins.point_in_interval(a.transit(spark, sf_dir), e, "lo_us", "hi_us", 6 * HOUR_US, "left")
    return pairs.groupBy("p.id").agg(F.min("i.episode_id").alias("episode_id")).withColumn("orphan", F.col("episode_id").isNull())


@query(
    "jn7_nearest_window",
    a.ctes("episode", "transit") + """, s AS (SELECT cam, min(start_us) AS lo, max(end_us) AS hi FROM episode GROUP BY cam),
    d AS (SELECT t.id, t.cam, t.ts_us, min(CASE WHEN t.ts_us BETWEEN e.start_us AND e.end_us THEN 0 WHEN t.ts_us < e.start_us THEN e.start_us - t.ts_us ELSE t.ts_us - e.end_us END) AS distance_us FROM transit t JOIN episode e ON e.cam = t.cam GROUP BY 1, 2, 3)
    SELECT t.id, t.cam, t.ts_us, CASE WHEN t.ts_us BETWEEN s.lo AND s.hi THEN d.distance_us END AS distance_us FROM transit t LEFT JOIN d ON d.id = t.id LEFT JOIN s ON s.cam = t.cam""",
)
def jn7_nearest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.nearest_window(a.transit(spark, sf_dir), a.episode(spark, sf_dir).select("cam", F.col("start_us").alias("lo"), F.col("end_us").alias("hi")))


@query(
    "jn8_declared_version",
    a.ctes("transit", "epochs") + """, f AS (SELECT t.id, t.cam, t.ts_us, e.from_us, e.version FROM transit t ASOF LEFT JOIN (SELECT * FROM epochs WHERE cam IS NULL) e ON t.ts_us >= e.from_us),
    s AS (SELECT f.id, e.from_us, e.version FROM f JOIN epochs e ON e.cam = f.cam AND e.from_us <= f.ts_us AND e.from_us > coalesce(f.from_us, 0))
    SELECT f.id, f.cam, coalesce(s.version, f.version, 'pre-declared') AS version FROM f LEFT JOIN s ON s.id = f.id""",
)
def jn8_declared_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.declared_version(a.transit(spark, sf_dir), a.version_epochs(spark)).select("id", "cam", "version")


@query(
    "jn9_measured_version",
    a.ctes("door", "transit") + """, v AS (SELECT cam, door_version, min(ts_us) AS lo, max(ts_us) AS hi FROM door GROUP BY 1, 2)
    SELECT t.id, arg_min(v.door_version, v.lo) AS door_version FROM transit t LEFT JOIN v ON v.cam = t.cam AND t.ts_us BETWEEN v.lo AND v.hi GROUP BY 1""",
)
def jn9_measured_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = a.door(spark, sf_dir).groupBy("cam", "door_version").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    return joins.point_in_interval(a.transit(spark, sf_dir), v, "lo", "hi", 24 * HOUR_US, "left").groupBy("p.id").agg(F.min_by("i.door_version", "i.lo").alias("door_version"))


@query(
    "jn13_in_window",
    a.ctes("episode", "transit") + " SELECT t.id, t.cam, t.ts_us FROM transit t WHERE EXISTS (SELECT 1 FROM episode e WHERE e.cam = t.cam AND t.ts_us BETWEEN e.start_us AND e.end_us + 600000000)",
)
def jn13_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", F.col("start_us").alias("lo_us"), (F.col("end_us") + 600 * US).alias("hi_us"))
    return joins.point_in_interval(a.transit(spark, sf_dir), e, "lo_us", "hi_us", 6 * HOUR_US, "left_semi").select("p.id", "p.cam", "p.ts_us")


SESSIONS = """
s0 AS (SELECT t.*, CASE WHEN ts_us < 1705363200000000 THEN 'count-v1' ELSE 'count-v2' END AS version, CASE WHEN direction = 'in' THEN 1 ELSE -1 END AS step FROM transit t),
s1 AS (SELECT *, CASE WHEN lag(ts_us) OVER w IS NULL OR ts_us - lag(ts_us) OVER w > 3600000000 OR version <> lag(version) OVER w THEN 1 ELSE 0 END AS new FROM s0 WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id)),
s2 AS (SELECT *, sum(new) OVER (PARTITION BY cam ORDER BY ts_us, id) AS period FROM s1),
s3 AS (SELECT *, sum(step) OVER (PARTITION BY cam, period ORDER BY ts_us, id) AS raw FROM s2),
ses AS (SELECT cam, version, period, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n, greatest(0, max(raw)) AS peak, least(0, min(raw)) AS low FROM s3 GROUP BY 1, 2, 3)"""


def occupancy_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.transit(spark, sf_dir).withColumns({"version": F.when(F.col("ts_us") < a._day(16), "count-v1").otherwise("count-v2"), "step": F.when(F.col("direction") == "in", 1).otherwise(-1)})
    t = carry.last_before(carry.with_day(t), ["cam"], {"prev": F.struct("ts_us", "version")})
    new = F.col("prev").isNull() | (F.col("ts_us") - F.col("prev.ts_us") > 3600 * US) | (F.col("version") != F.col("prev.version"))
    t = carry.total_up_to(t, ["cam"], {"period": new.cast("int")})
    t = t.withColumn("raw", F.sum("step").over(cycles.era_order("cam", "period")))
    return t.groupBy("cam", "version", "period").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("n"), F.greatest(F.lit(0), F.max("raw")).alias("peak"), F.least(F.lit(0), F.min("raw")).alias("low"))


query("wn7_occupancy_periods", a.ctes("transit") + "," + SESSIONS + " SELECT * FROM ses")(occupancy_periods)


@query("ag15_negative_periods", a.ctes("transit") + "," + SESSIONS + " SELECT cam, count(*) AS periods, round(100.0 * count(*) FILTER (WHERE low < 0) / count(*), 4) AS negative_pct FROM ses GROUP BY 1")
def ag15_negative_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy_periods(spark, sf_dir).groupBy("cam").agg(F.count("*").alias("periods"), F.round(100.0 * F.count_if(F.col("low") < 0) / F.count("*"), 4).alias("negative_pct"))


@query(
    "wn8_daily_peak",
    a.ctes("transit") + """, e AS (SELECT cam, ts_us, CAST(floor((ts_us + 19800000000) / 86400000000) AS BIGINT) AS day FROM transit),
    x AS (SELECT cam, day, (CAST(floor(ts_us / 1800000000) AS BIGINT) - s) * 1800000000 AS w0 FROM e, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE (CAST(floor(ts_us / 1800000000) AS BIGINT) - s) * 1800000000 >= day * 86400000000 - 19800000000),
    c AS (SELECT cam, day, w0, count(*) AS n FROM x GROUP BY 1, 2, 3) SELECT cam, day, max(n) AS peak, arg_min(w0, struct_pack(a := -n, b := w0)) AS w0 FROM c GROUP BY 1, 2""",
)
def wn8_daily_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two hours every half hour on the epoch's grid, within the local day; the earliest of equal peaks."""
    t = a.transit(spark, sf_dir).withColumn("day", F.floor((F.col("ts_us") + a.LOCAL_US) / a.DAY_US))
    slot = 1800 * US
    x = t.withColumn("w0", F.explode(F.array(*[(F.floor(F.col("ts_us") / slot) - s) * slot for s in range(4)]))).where(F.col("w0") >= F.col("day") * a.DAY_US - a.LOCAL_US)
    return x.groupBy("cam", "day", "w0").agg(F.count("*").alias("n")).groupBy("cam", "day").agg(F.max("n").alias("peak"), F.min_by("w0", F.struct(-F.col("n"), "w0")).alias("w0"))


@query(
    "sf12_nearest_rank",
    a.ctes("door") + f""", g AS (SELECT cam, list_sort(list(close_travel_s)) AS l FROM door WHERE close_travel_s IS NOT NULL GROUP BY cam) SELECT cam, CAST(len(l) AS BIGINT) AS n, {nr(0.5)} AS p50, {nr(0.85)} AS p85, {nr(0.95)} AS p95, l[CAST(floor(0.9 * (len(l) - 1)) AS BIGINT) + 1] AS p90_index FROM g""",
)
def sf12_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = stats.ranked(a.door(spark, sf_dir), ["cam"], "close_travel_s")
    return r.groupBy("cam").agg(F.max("n").alias("n"), stats.nearest_rank(0.5).alias("p50"), stats.nearest_rank(0.85).alias("p85"), stats.nearest_rank(0.95).alias("p95"), stats.index_rank(0.9).alias("p90_index"))


@query(
    "wn20_change_point",
    a.ctes("door") + """, h AS (SELECT cam, CAST(floor(ts_us / 86400000000) AS BIGINT) AS d, count(*) AS n, count(floor) AS f FROM door GROUP BY 1, 2),
    p AS (SELECT cam, d, sum(n) OVER w AS n1, sum(f) OVER w AS f1, sum(n) OVER (PARTITION BY cam) AS nt, sum(f) OVER (PARTITION BY cam) AS ft FROM h WINDOW w AS (PARTITION BY cam ORDER BY d)),
    s AS (SELECT cam, d, f1 / CAST(n1 AS DOUBLE) - (ft - f1) / CAST(nt - n1 AS DOUBLE) AS fall FROM p WHERE n1 >= 20 AND nt - n1 >= 20)
    SELECT cam, arg_min(d, struct_pack(a := -fall, b := d)) AS day, round(max(fall), 6) AS fall, max(fall) >= 0.25 AS strong FROM s GROUP BY cam""",
)
def wn20_change_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = a.door(spark, sf_dir).groupBy("cam", F.floor(F.col("ts_us") / a.DAY_US).alias("d")).agg(F.count("*").alias("n"), F.count("floor").alias("f"))
    w, whole = Window.partitionBy("cam").orderBy("d").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("cam")
    p = h.select("cam", "d", F.sum("n").over(w).alias("n1"), F.sum("f").over(w).alias("f1"), F.sum("n").over(whole).alias("nt"), F.sum("f").over(whole).alias("ft")).where("n1 >= 20 AND nt - n1 >= 20")
    s = p.withColumn("fall", F.col("f1") / F.col("n1") - (F.col("ft") - F.col("f1")) / (F.col("nt") - F.col("n1")))
    return s.groupBy("cam").agg(F.min_by("d", F.struct(-F.col("fall"), "d")).alias("day"), F.round(F.max("fall"), 6).alias("fall"), (F.max("fall") >= 0.25).alias("strong"))


@query(
    "sf17_cross_correlation",
    """WITH e AS (SELECT vec_id, embedding AS v, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS m FROM embeddings), n AS (SELECT vec_id, list_transform(v, lambda x: CAST(x AS DOUBLE) - m) AS v FROM e)
    SELECT a.vec_id AS a, b.vec_id AS b, round(CASE WHEN list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v) > 0 THEN list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v)) ELSE 0 END, 6) AS ncc
    FROM n a JOIN n b ON b.vec_id = a.vec_id + 1""",
)
def sf17_cross_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    n = e.select("vec_id", F.transform("v", lambda x: x - total(F.col("v")) / F.size("v")).alias("v"))
    left, right = n.select(F.col("vec_id").alias("a"), F.col("v").alias("x"), (F.col("vec_id") + 1).alias("b")), n.select(F.col("vec_id").alias("b"), F.col("v").alias("y"))
    dot = lambda p, q: total(F.zip_with(p, q, lambda s, t: s * t))
    size = dot(F.col("x"), F.col("x")) * dot(F.col("y"), F.col("y"))
    return left.join(right, "b").select("a", "b", F.round(F.when(size > 0, dot(F.col("x"), F.col("y")) / F.sqrt(size)).otherwise(0.0), 6).alias("ncc"))


def matched_sql(emissions: str) -> str:
    """A walk over each camera's emissions that carries the list of truths still free."""
    return f"""e AS (SELECT cam, ts_us, row_number() OVER (PARTITION BY cam ORDER BY ts_us) AS rn FROM {emissions}),
walk AS (
  SELECT cam, CAST(0 AS BIGINT) AS rn, NULL::BIGINT AS emitted_us, NULL::BIGINT AS truth_us, coalesce(list(ts_us ORDER BY ts_us) FILTER (WHERE door_state = 'opening'), []) AS free FROM door GROUP BY cam
  UNION ALL
  SELECT cam, rn, x, hit, CASE WHEN hit IS NULL THEN free ELSE list_concat(free[1:list_position(free, hit) - 1], free[list_position(free, hit) + 1:]) END
  FROM (SELECT w.cam, e.rn, e.ts_us AS x, w.free, list_sort(list_transform(list_filter(w.free, lambda t: abs(t - e.ts_us) <= {TRUTH_US}), lambda t: {{'d': abs(t - e.ts_us), 't': t}}))[1].t AS hit FROM walk w JOIN e ON e.cam = w.cam AND e.rn = w.rn + 1)),
m AS (SELECT cam, emitted_us, truth_us, CASE WHEN truth_us IS NULL THEN 'unmatched' ELSE 'matched' END AS kind FROM walk WHERE rn > 0
  UNION ALL SELECT cam, NULL, unnest(free), 'missed' FROM (SELECT cam, arg_max(free, rn) AS free FROM walk GROUP BY cam))"""


TRUTH_US = 1800 * US
EMITTED = "(SELECT cam, ts_us FROM door WHERE door_state = 'open')"
WITHIN = "EXISTS (SELECT 1 FROM episode s WHERE s.cam = x.cam AND {0} BETWEEN s.start_us AND s.end_us + 300000000)"


def _closings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a counter emits (open), the truth (opening), and windows in which the door stands still (300 s beyond each episode)."""
    d, e = a.door(spark, sf_dir), a.episode(spark, sf_dir)
    still = e.select("cam", F.col("start_us").alias("lo_us"), (F.col("end_us") + 300 * US).alias("hi_us"))
    return d.where("door_state = 'open'").select("cam", "ts_us"), d.where("door_state = 'opening'").select("cam", "ts_us"), still


@query("jn12_greedy_match", a.ctes("door").replace("WITH ", "WITH RECURSIVE ", 1) + f", {matched_sql(EMITTED)} SELECT * FROM m")
def jn12_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted, truth, _ = _closings(spark, sf_dir)
    return leftovers.greedy_match(emitted, truth, TRUTH_US)


@query(
    "jn12_truth_score",
    a.ctes("door", "episode").replace("WITH ", "WITH RECURSIVE ", 1) + f""", told AS (SELECT cam, ts_us, {WITHIN.format('x.ts_us')} AS phantom FROM {EMITTED} x), {matched_sql('(SELECT cam, ts_us FROM told WHERE NOT phantom)')}
    SELECT * FROM m UNION ALL SELECT cam, ts_us, NULL, 'phantom' FROM told WHERE phantom""",
)
def jn12_truth_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leftovers.graded(*_closings(spark, sf_dir), TRUTH_US, True, HOUR_US)


@query(
    "jn12_truth_grade",
    a.ctes("door", "episode").replace("WITH ", "WITH RECURSIVE ", 1) + f", {matched_sql(EMITTED)} SELECT cam, emitted_us, truth_us, CASE WHEN kind = 'unmatched' AND {WITHIN.format('x.emitted_us')} THEN 'phantom' ELSE kind END AS kind FROM m x",
)
def jn12_truth_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leftovers.graded(*_closings(spark, sf_dir), TRUTH_US, False, HOUR_US)


# order-dependent leftovers: iterative, per camera and era; rows-only checks here, brute force in the tests
@query("wn15_debounced_cycles")
def wn15_debounced_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leftovers.debounced_cycles(a.door(spark, sf_dir), 300 * US)


@query("sx6_sampling_quantum")
def sx6_sampling_quantum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leftovers.sampling_quantum(a.door(spark, sf_dir).where("door_state = 'closing'"), cycles.ERA, "close_travel_s")


@query("wn24_last_descents")
def wn24_last_descents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last full descent and the ramp of the signal k in the six hours around each episode."""
    e = a.episode(spark, sf_dir).select("cam", F.col("id").alias("window_id"), (F.col("start_us") - 3 * HOUR_US).alias("lo"), (F.col("start_us") + 3 * HOUR_US).alias("hi"))
    points = a.door(spark, sf_dir).select("cam", "ts_us", F.col("k").cast("double").alias("value"))
    return leftovers.descents_around(points, e, 80.0, 20.0, 6 * HOUR_US)
