"""The survey's rules in full: door pools, coefficients and findings, health, signals, exports. Durations follow the driver's profile (production seconds
times 300) where a rule is about the pace of events. The DuckDB statements are written from the rules, apart from the plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import carry, cycles, joins
from ..registry import query
from ..sources import adapters as a
from .sequences import FLAP_CYCLES, HOUR_US, TRIPS, US, _flap_cycles, _trips, wn8_daily_peak

#: Declared values of the study: assumed close and open travel, cliff, seconds a person, least plausible close; people in the building and the share designed for.
SHEET_CLOSE, SHEET_OPEN, CLIFF, PER_PERSON, LEAST_CLOSE = 8.0, 900.0, 10.0, 450.0, 0.5
POPULATION, DESIGN_PCT = 1500, 8.0
Z = stats.Z95
rounded = lambda c, n=6: F.round(c, n)


# ---- door pools -------------------------------------------------------------------------------------------------------------------------------
def loaded_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles with load: the crossings between opening and close (0 where none; cycles without a start have none)."""
    c = _flap_cycles(spark, sf_dir)
    keyed = c.where("ts_us IS NOT NULL").withColumnRenamed("ts_us", "lo_us")
    pairs = joins.point_in_interval(a.transit(spark, sf_dir), keyed, "lo_us", "close_us", 6 * HOUR_US)
    load = pairs.groupBy(F.col("i.cam").alias("cam"), F.col("i.door_version").alias("door_version"), F.col("i.close_us").alias("close_us")).agg(F.count("*").alias("load"))
    return c.join(load, ["cam", "door_version", "close_us"], "left").withColumn("load", F.coalesce("load", F.lit(0)))


LOADED = FLAP_CYCLES + """,
lc AS (SELECT c.*, (SELECT count(*) FROM transit t WHERE t.cam = c.cam AND t.ts_us >= c.ts_us AND t.ts_us <= c.close_us) AS load FROM fc c)"""
#: Order statistics of a sorted list l in DuckDB.
MEDIAN = "l[least(len(l), CAST(floor(0.5 * len(l)) AS BIGINT) + 1)]"
LO = "CASE WHEN len(l) >= 6 THEN l[greatest(1, CAST(floor(len(l) / 2.0 - 1.959963984540054 * sqrt(len(l)) / 2) AS BIGINT))] END"
HI = "CASE WHEN len(l) >= 6 THEN l[least(len(l), CAST(ceil(1 + len(l) / 2.0 + 1.959963984540054 * sqrt(len(l)) / 2) AS BIGINT))] END"


def mean_interval(value: str) -> tuple[Column, Column, Column]:
    """Aggregates: mean, and its interval of 95 %, null below two values."""
    m, h = F.avg(value), F.lit(Z) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return m, F.when(F.count(value) > 1, m - h), F.when(F.count(value) > 1, m + h)


@query(
    "ag16_door_pools",
    a.ctes("door", "transit") + "," + LOADED + f""",
    x AS (SELECT cam, door_version, list_sort(list(dwell_s / load)) AS l, avg(dwell_s / load) AS m FROM lc WHERE class = 'clean' AND load > 0 AND dwell_s > 0 GROUP BY 1, 2),
    p AS (SELECT cam, door_version, count(*) AS n_all, count(*) FILTER (WHERE class = 'clean') AS n_clean, count(*) FILTER (WHERE class = 'flap') AS n_flap, count(*) FILTER (WHERE class = 'reopened') AS n_reopened,
      count(*) FILTER (WHERE class = 'implausible') AS n_impossible, round(100.0 * count(*) FILTER (WHERE class = 'reopened') / count(*), 4) AS reopen_pct,
      round(100.0 * count(*) FILTER (WHERE class = 'clean' AND close_travel_s > {CLIFF}) / nullif(count(*) FILTER (WHERE class = 'clean'), 0), 4) AS over_pct,
      list_sort(list(close_travel_s) FILTER (WHERE class = 'clean')) AS l FROM lc GROUP BY 1, 2)
    SELECT p.cam, p.door_version, n_all, n_clean, n_flap, n_reopened, n_impossible, reopen_pct, over_pct, p.{MEDIAN.replace('(l)', '(p.l)')} AS median_close_s, CAST(coalesce(len(x.l), 0) AS BIGINT) AS n_transfer,
      round(x.{MEDIAN.replace('(l)', '(x.l)')}, 6) AS median_transfer_s, round(x.m, 6) AS mean_transfer_s FROM p LEFT JOIN x ON x.cam = p.cam AND x.door_version = p.door_version""",
)
def ag16_door_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = loaded_cycles(spark, sf_dir)
    kind = lambda k: F.count_if(F.col("class") == k)
    over = F.count_if((F.col("class") == "clean") & (F.col("close_travel_s") > CLIFF))
    counts = c.groupBy(*cycles.ERA).agg(F.count("*").alias("n_all"), kind("clean").alias("n_clean"), kind("flap").alias("n_flap"), kind("reopened").alias("n_reopened"), kind("implausible").alias("n_impossible"),
        rounded(100.0 * kind("reopened") / F.count("*"), 4).alias("reopen_pct"), rounded(F.try_divide(100.0 * over, kind("clean")), 4).alias("over_pct"))
    clean = c.where("class = 'clean'")
    close = stats.ranked(clean, cycles.ERA, "close_travel_s").groupBy(*cycles.ERA).agg(stats.nearest_rank(0.5).alias("median_close_s"))
    each = clean.where("load > 0 AND dwell_s > 0").withColumn("v", F.col("dwell_s") / F.col("load"))
    transfer = stats.ranked(each.drop("n"), cycles.ERA, "v").groupBy(*cycles.ERA).agg(F.max("n").alias("n_transfer"), rounded(stats.nearest_rank(0.5)).alias("median_transfer_s"))
    mean = each.groupBy(*cycles.ERA).agg(rounded(F.avg("v")).alias("mean_transfer_s"))
    return counts.join(close, cycles.ERA, "left").join(transfer, cycles.ERA, "left").join(mean, cycles.ERA, "left").withColumn("n_transfer", F.coalesce("n_transfer", F.lit(0)))


@query(
    "sx2_median_interval",
    a.ctes("door") + f""", g AS (SELECT cam, door_version, list_sort(list(close_travel_s)) AS l FROM door WHERE door_state = 'closing' AND close_travel_s IS NOT NULL GROUP BY 1, 2)
    SELECT cam, door_version, CAST(len(l) AS BIGINT) AS n, {MEDIAN} AS median_s, {LO} AS lo_s, {HI} AS hi_s FROM g""",
)
def sx2_median_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = stats.median_interval()
    r = stats.ranked(a.door(spark, sf_dir).where("door_state = 'closing'"), cycles.ERA, "close_travel_s")
    return r.groupBy(*cycles.ERA).agg(F.max("n").alias("n"), stats.nearest_rank(0.5).alias("median_s"), lo.alias("lo_s"), hi.alias("hi_s"))


# ---- coefficients -----------------------------------------------------------------------------------------------------------------------------
def verdict(lo: Column, hi: Column, threshold: Column) -> Column:
    return F.when(threshold.isNull(), "no sheet value").when(lo.isNull() | hi.isNull(), "too few").when(lo > threshold, "above").when(hi < threshold, "below").otherwise("straddles")


VERDICT = "CASE WHEN threshold IS NULL THEN 'no sheet value' WHEN lo IS NULL OR hi IS NULL THEN 'too few' WHEN lo > threshold THEN 'above' WHEN hi < threshold THEN 'below' ELSE 'straddles' END"
COEFFICIENTS = a.ctes("door", "transit") + "," + LOADED + f""",
ok AS (SELECT * FROM lc WHERE class = 'clean'),
med AS (SELECT cam, door_version, 'C27 close travel' AS coefficient, {SHEET_CLOSE} AS assumption, {CLIFF} AS threshold, list_sort(list(close_travel_s)) AS l FROM ok WHERE close_travel_s >= {LEAST_CLOSE} GROUP BY 1, 2
  UNION ALL SELECT cam, door_version, 'C27 open travel', {SHEET_OPEN}, {SHEET_OPEN}, list_sort(list(open_travel_s)) FROM ok WHERE open_travel_s > 0 GROUP BY 1, 2),
val AS (SELECT cam, door_version, 'C26 transfer' AS coefficient, {PER_PERSON} AS assumption, {PER_PERSON} AS threshold, dwell_s / load AS v FROM ok WHERE load > 0 AND dwell_s > 0
  UNION ALL SELECT cam, door_version, 'C19 passengers a trip', NULL, NULL, load FROM ok WHERE load > 0
  UNION ALL SELECT cam, door_version, 'B24 lost time', NULL, NULL, dwell_s - {PER_PERSON} * load FROM ok WHERE load > 0 AND dwell_s > 0),
mean AS (SELECT cam, door_version, coefficient, max(assumption) AS assumption, max(threshold) AS threshold, count(*) AS n, avg(v) AS observed,
  CASE WHEN count(*) > 1 THEN avg(v) - 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) END AS lo, CASE WHEN count(*) > 1 THEN avg(v) + 1.959963984540054 * stddev_samp(v) / sqrt(count(*)) END AS hi FROM val GROUP BY 1, 2, 3),
both_ AS (SELECT cam, door_version, coefficient, assumption, threshold, CAST(len(l) AS BIGINT) AS n, {MEDIAN} AS observed, {LO} AS lo, {HI} AS hi FROM med UNION ALL SELECT * FROM mean),
gate AS (SELECT count(DISTINCT CASE WHEN floor IS NOT NULL AND reason IN ('ok', 'single_panel') THEN cam END) AS reading FROM door),
co AS (SELECT cam, door_version, coefficient, CAST(assumption AS DOUBLE) AS assumption, CAST(threshold AS DOUBLE) AS threshold, n, round(observed, 6) AS observed, round(lo, 6) AS lo, round(hi, 6) AS hi, {VERDICT} AS verdict FROM both_
  UNION ALL SELECT NULL, NULL, c, NULL, NULL, 0, NULL, NULL, NULL, CASE WHEN c IN ('C21 speed factor up', 'C22 speed factor down') THEN 'not measurable: no rated speed and floor height' WHEN reading = 0 THEN 'not measurable: no floor reads'
    ELSE 'not measurable: trips not told apart' END FROM gate, (SELECT unnest(['C17 stops up', 'C18 stops down', 'C21 speed factor up', 'C22 speed factor down']) AS c))"""


def coefficient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of the eight coefficients (C27 twice) and era: medians with order-statistic intervals for travel, means for what people do; those that can't be
    measured stay, with the reason, derived from the data."""
    ok = loaded_cycles(spark, sf_dir).where("class = 'clean'")
    lo, hi = stats.median_interval()
    keys, number = [*cycles.ERA, "coefficient", "assumption", "threshold"], lambda x: F.lit(x).cast("double")
    travel = ok.select(*cycles.ERA, F.explode(F.array(
        F.struct(F.lit("C27 close travel").alias("coefficient"), number(SHEET_CLOSE).alias("assumption"), number(CLIFF).alias("threshold"), F.when(F.col("close_travel_s") >= LEAST_CLOSE, F.col("close_travel_s")).alias("v")),
        F.struct(F.lit("C27 open travel").alias("coefficient"), number(SHEET_OPEN).alias("assumption"), number(SHEET_OPEN).alias("threshold"), F.when(F.col("open_travel_s") > 0, F.col("open_travel_s")).alias("v")),
    )).alias("x")).select(*cycles.ERA, "x.*")
    medians = stats.ranked(travel.withColumnRenamed("v", "value"), keys, "value").groupBy(*keys).agg(F.max("n").alias("n"), stats.nearest_rank(0.5).alias("observed"), lo.alias("lo"), hi.alias("hi"))
    held = (F.col("load") > 0) & (F.col("dwell_s") > 0)
    people = ok.select(*cycles.ERA, F.explode(F.array(
        F.struct(F.lit("C26 transfer").alias("coefficient"), number(PER_PERSON).alias("assumption"), number(PER_PERSON).alias("threshold"), F.when(held, F.col("dwell_s") / F.col("load")).alias("v")),
        F.struct(F.lit("C19 passengers a trip").alias("coefficient"), number(None).alias("assumption"), number(None).alias("threshold"), F.when(F.col("load") > 0, F.col("load")).cast("double").alias("v")),
        F.struct(F.lit("B24 lost time").alias("coefficient"), number(None).alias("assumption"), number(None).alias("threshold"), F.when(held, F.col("dwell_s") - PER_PERSON * F.col("load")).alias("v")),
    )).alias("x")).select(*cycles.ERA, "x.*").where("v IS NOT NULL")
    m, m_lo, m_hi = mean_interval("v")
    means = people.groupBy(*keys).agg(F.count("*").alias("n"), m.alias("observed"), m_lo.alias("lo"), m_hi.alias("hi"))
    rows = medians.unionByName(means).withColumn("verdict", verdict(F.col("lo"), F.col("hi"), F.col("threshold")))
    rows = rows.withColumns({c: rounded(F.col(c)) for c in ("observed", "lo", "hi")})
    reading = a.door(spark, sf_dir).agg(F.count_if(F.col("floor").isNotNull() & F.col("reason").isin("ok", "single_panel")).alias("reads"))
    names = F.explode(F.array(*map(F.lit, ("C17 stops up", "C18 stops down", "C21 speed factor up", "C22 speed factor down")))).alias("coefficient")
    why = F.when(F.col("coefficient").startswith("C2"), "not measurable: no rated speed and floor height").when(F.col("reads") == 0, "not measurable: no floor reads").otherwise("not measurable: trips not told apart")
    blocked = reading.select(names, "reads").select("coefficient", F.lit(0).cast("long").alias("n"), why.alias("verdict"))
    return rows.unionByName(blocked, allowMissingColumns=True)


query("sx13_coefficient_rows", COEFFICIENTS + " SELECT * FROM co")(coefficient_rows)


@query("sx18_withheld_rows", COEFFICIENTS + """ SELECT coefficient, CASE WHEN verdict LIKE 'not measurable%' THEN verdict WHEN n < 30 THEN 'fewer than 30 values' WHEN lo IS NULL THEN 'no interval' WHEN hi - lo > 0.5 * abs(observed) THEN 'interval too wide' END AS reason, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_values
  FROM co WHERE verdict LIKE 'not measurable%' OR n < 30 OR lo IS NULL OR hi - lo > 0.5 * abs(observed) GROUP BY 1, 2""")
def sx18_withheld_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is withheld, and why: per coefficient and reason, the rows and the values behind them."""
    c = coefficient_rows(spark, sf_dir)
    reason = F.when(F.col("verdict").startswith("not measurable"), F.col("verdict")).when(F.col("n") < 30, "fewer than 30 values").when(F.col("lo").isNull(), "no interval").when(F.col("hi") - F.col("lo") > 0.5 * F.abs("observed"), "interval too wide")
    return c.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("coefficient", "reason").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_values"))


@query(
    "sx14_blocker_evidence",
    a.ctes("door") + """, d AS (SELECT cam, count(*) AS n, count(*) FILTER (WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')) AS sure, count(*) FILTER (WHERE direction = 'up') AS up, count(*) FILTER (WHERE direction = 'down') AS down FROM door GROUP BY 1),
    e AS (SELECT CAST(sum(sure) AS BIGINT) AS sure, CAST(sum(n) AS BIGINT) AS n, count(*) AS cams, count(*) FILTER (WHERE sure > 0) AS reading, count(*) FILTER (WHERE up > 0 AND down > 0 AND greatest(up, down) <= 0.95 * (up + down)) AS telling FROM d)
    SELECT 'C17' AS coefficient, sure || ' confident reads of ' || n || ' rows; ' || reading || ' of ' || cams || ' cameras read floors' AS evidence, CASE WHEN reading = 0 THEN 'no floor reads' WHEN telling = 0 THEN 'no direction' ELSE 'trips' END AS blocker FROM e
    UNION ALL SELECT 'C18', sure || ' confident reads of ' || n || ' rows; ' || reading || ' of ' || cams || ' cameras read floors', CASE WHEN reading = 0 THEN 'no floor reads' WHEN telling = 0 THEN 'no direction' ELSE 'trips' END FROM e
    UNION ALL SELECT 'C21', telling || ' of ' || cams || ' cameras name both directions', 'no rated speed' FROM e UNION ALL SELECT 'C22', telling || ' of ' || cams || ' cameras name both directions', 'no rated speed' FROM e""",
)
def sx14_blocker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = F.count_if(F.col("direction") == "up"), F.count_if(F.col("direction") == "down")
    sure = F.count_if(F.col("floor").isNotNull() & F.col("reason").isin("ok", "single_panel"))
    d = a.door(spark, sf_dir).groupBy("cam").agg(F.count("*").alias("n"), sure.alias("sure"), ((up > 0) & (down > 0) & (F.greatest(up, down) <= 0.95 * (up + down))).alias("tells"))
    e = d.agg(F.sum("sure").alias("sure"), F.sum("n").alias("n"), F.count("*").alias("cams"), F.count_if(F.col("sure") > 0).alias("reading"), F.count_if("tells").alias("telling"))
    reads = F.concat("sure", F.lit(" confident reads of "), "n", F.lit(" rows; "), "reading", F.lit(" of "), "cams", F.lit(" cameras read floors"))
    tells = F.concat("telling", F.lit(" of "), "cams", F.lit(" cameras name both directions"))
    stops = F.when(F.col("reading") == 0, "no floor reads").when(F.col("telling") == 0, "no direction").otherwise("trips")
    row = lambda c, evidence, blocker: F.struct(F.lit(c).alias("coefficient"), evidence.alias("evidence"), blocker.alias("blocker"))
    return e.select(F.explode(F.array(row("C17", reads, stops), row("C18", reads, stops), row("C21", tells, F.lit("no rated speed")), row("C22", tells, F.lit("no rated speed")))).alias("r")).select("r.*")


# ---- findings ---------------------------------------------------------------------------------------------------------------------------------
COVERAGE = """
cov AS (SELECT cam, 100.0 * count(DISTINCT slot) / (SELECT count(DISTINCT CAST(floor(ts_us / 3600000000) AS BIGINT)) FROM door) AS pct FROM (SELECT cam, CAST(floor(ts_us / 3600000000) AS BIGINT) AS slot FROM door) GROUP BY cam),
hours AS (SELECT CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24 AS hour, cam, count(*) AS n FROM transit WHERE direction = 'in' GROUP BY 1, 2),
cv AS (SELECT hour, stddev_samp(n) / avg(n) AS cv FROM hours GROUP BY 1 HAVING count(*) >= 3),
peaks AS (SELECT day, max(n) AS peak FROM (SELECT CAST(floor((ts_us + 19800000000) / 86400000000) AS BIGINT) AS day, CAST(floor(ts_us / 90000000000) AS BIGINT) AS w, count(*) AS n FROM transit WHERE direction = 'in' GROUP BY 1, 2) GROUP BY 1)"""
FINDINGS = COEFFICIENTS + "," + COVERAGE + f""",
cl AS (SELECT * FROM co WHERE coefficient = 'C27 close travel'),
tally AS (SELECT count(*) FILTER (WHERE verdict = 'above') AS over, count(*) FILTER (WHERE verdict = 'below') AS under, count(*) FILTER (WHERE verdict IN ('straddles', 'too few')) AS straddle, CAST(sum(n) AS BIGINT) AS n FROM cl),
firm AS (SELECT * FROM cl WHERE n >= 30 AND lo IS NOT NULL),
ends AS (SELECT arg_min(struct_pack(cam := cam, m := observed, hi := hi), struct_pack(o := observed, c := cam, v := door_version)) AS lo, arg_min(struct_pack(cam := cam, m := observed, lo := lo), struct_pack(o := -observed, c := cam, v := door_version)) AS hi, count(*) AS k FROM firm),
ot AS (SELECT cam, door_version, open_travel_s AS v, min(open_travel_s) OVER (PARTITION BY cam, door_version) AS least FROM ok WHERE open_travel_s > 0),
pinned AS (SELECT cam, door_version, count(*) AS n, avg(CASE WHEN v <= least * 1.02 THEN 1.0 ELSE 0.0 END) AS share FROM ot GROUP BY 1, 2),
short AS (SELECT cam, door_version, count(*) AS n, count(*) FILTER (WHERE close_travel_s < {LEAST_CLOSE}) AS k FROM ok GROUP BY 1, 2)
SELECT 'compliance' AS rule, 'fleet' AS subject, CASE WHEN over + under > 0 AND straddle = 0 AND n >= 100 THEN 'HIGH' WHEN n >= 30 THEN 'MEDIUM' ELSE 'TOO EARLY' END AS level, n, CAST(over AS DOUBLE) AS value FROM tally
UNION ALL SELECT 'compliance of a lift', cam || ' ' || door_version, CASE WHEN n >= 100 AND verdict IN ('above', 'below') THEN 'HIGH' WHEN n >= 30 THEN 'MEDIUM' ELSE 'TOO EARLY' END, n, observed FROM cl
UNION ALL SELECT 'divergence', hi.cam || ' over ' || lo.cam, 'TOO EARLY', k, round(hi.m - lo.m, 6) FROM ends WHERE k >= 2 AND hi.cam <> lo.cam AND hi.m - lo.m >= 0.5 AND hi.lo > lo.hi
UNION ALL SELECT 'open travel', cam || ' ' || door_version, 'TOO EARLY', n, round(share, 6) FROM pinned WHERE share > 0.2
UNION ALL SELECT 'short closes', cam || ' ' || door_version, CASE WHEN n - k >= 30 THEN 'MEDIUM' ELSE 'TOO EARLY' END, n, round(k / CAST(n AS DOUBLE), 6) FROM short WHERE k > 0.05 * n
UNION ALL SELECT 'load balance', CASE WHEN avg(cv) < 0.25 THEN 'even' WHEN avg(cv) < 0.6 THEN 'uneven' ELSE 'concentrated' END, CASE WHEN (SELECT max(pct) - min(pct) FROM cov) > 20 THEN 'TOO EARLY' ELSE 'MEDIUM' END, count(*), round(avg(cv), 6) FROM cv HAVING count(*) > 0
UNION ALL SELECT 'peak', 'fleet', CASE WHEN count(*) >= 5 THEN 'MEDIUM' ELSE 'TOO EARLY' END, count(*), CAST(max(peak) AS DOUBLE) FROM peaks HAVING count(*) > 0
UNION ALL SELECT 'coverage', 'lowest', 'MEDIUM', count(*), round(min(pct), 6) FROM cov WHERE pct > 0 HAVING count(*) > 0
UNION ALL SELECT 'coverage', 'highest', 'MEDIUM', count(*), round(max(pct), 6) FROM cov WHERE pct > 0 HAVING count(*) > 0
UNION ALL SELECT 'transfer', cam || ' ' || door_version, CASE WHEN n >= 100 AND verdict IN ('above', 'below') THEN 'HIGH' WHEN n >= 30 THEN 'MEDIUM' ELSE 'TOO EARLY' END, n, observed FROM co WHERE coefficient = 'C26 transfer'
UNION ALL SELECT 'floors', 'blocked', 'TOO EARLY', count(*), 0.0 FROM door HAVING count(*) > 0 AND count(*) FILTER (WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')) = 0
UNION ALL SELECT 'demand', 'hour ' || arg_min(hour, struct_pack(a := -n, b := hour)), 'MEDIUM', CAST(sum(n) AS BIGINT), round(max(n) / avg(n), 6) FROM (SELECT hour, sum(n) AS n FROM hours GROUP BY 1) HAVING count(*) > 0"""


@query("sx16_findings", FINDINGS)
def sx16_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten finding rules as rows: rule, subject, level (HIGH, MEDIUM, TOO EARLY), the n behind it and its figure."""
    co, ok = coefficient_rows(spark, sf_dir), loaded_cycles(spark, sf_dir).where("class = 'clean'")
    door, transit = a.door(spark, sf_dir), a.transit(spark, sf_dir)
    n, era = F.col("n"), F.concat_ws(" ", "cam", "door_version")
    one_side = F.col("verdict").isin("above", "below")
    level = F.when((n >= 100) & one_side, "HIGH").when(n >= 30, "MEDIUM").otherwise("TOO EARLY")
    out = lambda df, rule, subject, level, n, value: df.select(F.lit(rule).alias("rule"), subject.alias("subject"), level.alias("level"), n.cast("long").alias("n"), value.cast("double").alias("value"))
    close = co.where("coefficient = 'C27 close travel'")
    tally = close.agg(F.count_if(F.col("verdict") == "above").alias("over"), F.count_if(one_side).alias("sides"), F.count_if(F.col("verdict").isin("straddles", "too few")).alias("straddle"), F.sum("n").alias("n"))
    fleet = F.when((F.col("sides") > 0) & (F.col("straddle") == 0) & (n >= 100), "HIGH").when(n >= 30, "MEDIUM").otherwise("TOO EARLY")
    pool = F.struct("cam", "observed", "lo", "hi")
    ends = close.where("n >= 30 AND lo IS NOT NULL").agg(F.min_by(pool, F.struct("observed", "cam", "door_version")).alias("least"), F.min_by(pool, F.struct(-F.col("observed"), "cam", "door_version")).alias("most"), F.count("*").alias("n"))
    gap = F.col("most.observed") - F.col("least.observed")
    apart = ends.where((n >= 2) & (F.col("most.cam") != F.col("least.cam")) & (gap >= 0.5) & (F.col("most.lo") > F.col("least.hi")))
    opens = ok.where("open_travel_s > 0")
    least = opens.groupBy(*cycles.ERA).agg(F.min("open_travel_s").alias("least"))
    pinned = opens.join(least, cycles.ERA).groupBy(*cycles.ERA).agg(F.count("*").alias("n"), F.avg(F.when(F.col("open_travel_s") <= F.col("least") * 1.02, 1.0).otherwise(0.0)).alias("share")).where("share > 0.2")
    short = ok.groupBy(*cycles.ERA).agg(F.count("*").alias("n"), F.count_if(F.col("close_travel_s") < LEAST_CLOSE).alias("k")).where("k > 0.05 * n")
    slot = F.floor(F.col("ts_us") / HOUR_US)
    all_slots = door.agg(F.countDistinct(slot)).first()[0]
    cover = door.groupBy("cam").agg(F.countDistinct(slot).alias("c")).withColumn("pct", 100.0 * F.col("c") / all_slots)
    spread = cover.agg(F.count_if(F.col("pct") > 0).alias("n"), F.min(F.when(F.col("pct") > 0, F.col("pct"))).alias("lo"), F.max("pct").alias("hi"), (F.max("pct") - F.min("pct")).alias("spread"))
    boarded = transit.where("direction = 'in'")
    hours = boarded.groupBy(cycles.labelled_local_hour(F.col("ts_us")).alias("hour"), "cam").agg(F.count("*").alias("n"))
    cv = hours.groupBy("hour").agg((F.stddev_samp("n") / F.avg("n")).alias("cv"), F.count("*").alias("lifts")).where("lifts >= 3").agg(F.avg("cv").alias("cv"), F.count("*").alias("n")).where("n > 0")
    uneven = (spread.first()["spread"] or 0) > 20
    balance = F.when(F.col("cv") < 0.25, "even").when(F.col("cv") < 0.6, "uneven").otherwise("concentrated")
    local_day = F.floor((F.col("ts_us") + a.LOCAL_US) / a.DAY_US)
    peaks = boarded.groupBy(local_day.alias("day"), F.floor(F.col("ts_us") / (90_000 * US)).alias("w")).agg(F.count("*").alias("n")).groupBy("day").agg(F.max("n").alias("peak")).agg(F.count("*").alias("n"), F.max("peak").alias("peak")).where("n > 0")
    floors = door.agg(F.count("*").alias("n"), F.count_if(F.col("floor").isNotNull() & F.col("reason").isin("ok", "single_panel")).alias("sure")).where("n > 0 AND sure = 0")
    demand = hours.groupBy("hour").agg(F.sum("n").alias("n")).agg(F.min_by("hour", F.struct(-n, "hour")).alias("hour"), F.sum("n").alias("n"), (F.max("n") / F.avg("n")).alias("ratio")).where("n > 0")
    early, medium = F.lit("TOO EARLY"), F.lit("MEDIUM")
    parts = [
        out(tally, "compliance", F.lit("fleet"), fleet, n, F.col("over")),
        out(close, "compliance of a lift", era, level, n, F.col("observed")),
        out(apart, "divergence", F.concat("most.cam", F.lit(" over "), "least.cam"), early, n, rounded(gap)),
        out(pinned, "open travel", era, early, n, rounded(F.col("share"))),
        out(short, "short closes", era, F.when(n - F.col("k") >= 30, "MEDIUM").otherwise("TOO EARLY"), n, rounded(F.col("k") / n)),
        out(cv, "load balance", balance, F.lit("TOO EARLY" if uneven else "MEDIUM"), n, rounded(F.col("cv"))),
        out(peaks, "peak", F.lit("fleet"), F.when(n >= 5, "MEDIUM").otherwise("TOO EARLY"), n, F.col("peak")),
        out(spread.where("n > 0"), "coverage", F.lit("lowest"), medium, n, rounded(F.col("lo"))),
        out(spread.where("n > 0"), "coverage", F.lit("highest"), medium, n, rounded(F.col("hi"))),
        out(co.where("coefficient = 'C26 transfer'"), "transfer", era, level, n, F.col("observed")),
        out(floors, "floors", F.lit("blocked"), early, n, F.lit(0.0)),
        out(demand, "demand", F.concat(F.lit("hour "), "hour"), medium, n, rounded(F.col("ratio"))),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


# ---- peak windows, round trips, occupancy ---------------------------------------------------------------------------------------------------------
PEAKS = """
pe AS (SELECT cam, ts_us, CAST(floor((ts_us + 19800000000) / 86400000000) AS BIGINT) AS day FROM transit),
px AS (SELECT cam, day, (CAST(floor(ts_us / 1800000000) AS BIGINT) - s) * 1800000000 AS w0 FROM pe, (SELECT unnest([0, 1, 2, 3]) AS s) WHERE (CAST(floor(ts_us / 1800000000) AS BIGINT) - s) * 1800000000 >= day * 86400000000 - 19800000000),
pk AS (SELECT cam, day, max(n) AS peak, arg_min(w0, struct_pack(a := -n, b := w0)) AS w0 FROM (SELECT cam, day, w0, count(*) AS n FROM px GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query(
    "ag29_peak_cycles",
    a.ctes("door", "transit") + "," + FLAP_CYCLES + "," + PEAKS + f""",
    s AS (SELECT c.*, EXISTS (SELECT 1 FROM pk WHERE pk.cam = c.cam AND c.ts_us >= pk.w0 AND c.ts_us < pk.w0 + 7200000000) AS inside FROM fc c WHERE class = 'clean' AND ts_us IS NOT NULL),
    u AS (SELECT cam, 'peak' AS part, list_sort(list(close_travel_s)) AS l FROM s WHERE inside GROUP BY 1 UNION ALL SELECT cam, 'all day', list_sort(list(close_travel_s)) FROM s GROUP BY 1),
    b AS (SELECT cam, max(peak) AS most FROM pk GROUP BY 1)
    SELECT u.cam, part, CAST(len(l) AS BIGINT) AS n, {MEDIAN} AS median_s, {LO} AS lo_s, {HI} AS hi_s, round(100.0 * b.most / {POPULATION}, 6) AS peak_pct, 100.0 * b.most / {POPULATION} > {DESIGN_PCT} AS over_design FROM u JOIN b ON b.cam = u.cam""",
)
def ag29_peak_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean cycles that start in their day's busiest window beside all of the lift's, and the busiest window's share of the building."""
    pk = wn8_daily_peak(spark, sf_dir)
    c = _flap_cycles(spark, sf_dir).where("class = 'clean' AND ts_us IS NOT NULL").select("cam", "ts_us", "close_travel_s")
    windows = pk.select("cam", F.col("w0").alias("lo"), (F.col("w0") + 7200 * US - 1).alias("hi"))
    inside = joins.point_in_interval(c, windows, "lo", "hi", 2 * HOUR_US, "left_semi").select(F.col("p.cam").alias("cam"), F.lit("peak").alias("part"), F.col("p.close_travel_s").alias("close_travel_s"))
    both = inside.unionByName(c.select("cam", F.lit("all day").alias("part"), "close_travel_s"))
    lo, hi = stats.median_interval()
    s = stats.ranked(both, ["cam", "part"], "close_travel_s").groupBy("cam", "part").agg(F.max("n").alias("n"), stats.nearest_rank(0.5).alias("median_s"), lo.alias("lo_s"), hi.alias("hi_s"))
    share = 100.0 * F.col("most") / POPULATION
    return s.join(pk.groupBy("cam").agg(F.max("peak").alias("most")), "cam").select("cam", "part", "n", "median_s", "lo_s", "hi_s", rounded(share).alias("peak_pct"), (share > DESIGN_PCT).alias("over_design"))


@query(
    "ag13_rtt_grid",
    a.ctes("door", "channels") + ", " + TRIPS + """,
    h AS (SELECT cam, CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24 AS hour, count(*) AS trips, median(rtt_s) AS m FROM trips GROUP BY 1, 2),
    s AS (SELECT cam, bool_or(floor IS NOT NULL AND reason IN ('ok', 'single_panel')) AS reads, bool_or(floor = 'G') AS home FROM door GROUP BY 1)
    SELECT g.cam, g.hour, coalesce(h.trips, 0) AS trips, CASE WHEN h.trips >= 3 THEN round(h.m, 4) END AS median_s,
      CASE WHEN NOT coalesce(s.reads, false) THEN 'uncalibrated' WHEN NOT coalesce(s.home, false) THEN 'designed' WHEN h.trips IS NULL THEN 'pending' WHEN h.trips < 3 THEN 'refused' ELSE 'ok' END AS state
    FROM (SELECT 'ch' || channel AS cam, CAST(unnest(range(0, 24)) AS BIGINT) AS hour FROM channels) g LEFT JOIN h ON h.cam = g.cam AND h.hour = g.hour LEFT JOIN s ON s.cam = g.cam""",
)
def ag13_rtt_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lift and hour: the median round trip, or why there is none (absence is not zero)."""
    door = a.door(spark, sf_dir)
    sure = F.col("floor").isNotNull() & F.col("reason").isin("ok", "single_panel")
    known = door.groupBy("cam").agg(F.bool_or(sure).alias("reads"), F.bool_or(F.col("floor") == "G").alias("home"))
    t = _trips(spark, sf_dir).withColumn("hour", cycles.labelled_local_hour(F.col("ts_us")))
    h = stats.ranked(t, ["cam", "hour"], "rtt_s").groupBy("cam", "hour").agg(F.max("n").alias("trips"), stats.linear(0.5).alias("m"))
    grid = a.channels(spark).select(F.concat(F.lit("ch"), "channel").alias("cam"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    state = F.when(no(F.col("reads")), "uncalibrated").when(no(F.col("home")), "designed").when(F.col("trips").isNull(), "pending").when(F.col("trips") < 3, "refused").otherwise("ok")
    out = grid.join(h, ["cam", "hour"], "left").join(known, "cam", "left").withColumn("state", state)
    return out.select("cam", "hour", F.coalesce("trips", F.lit(0)).alias("trips"), F.when(F.col("trips") >= 3, F.round("m", 4)).alias("median_s"), "state")


@query(
    "ag14_occupancy_ranks",
    a.ctes("episode") + f""", e AS (SELECT cam, list_sort(list(occupancy_max) FILTER (WHERE counting_version = 'count-v2' AND occupancy_frames > 0)) AS l, count(*) FILTER (WHERE counting_version <> 'count-v2') AS off_era,
      count(*) FILTER (WHERE counting_version = 'count-v2' AND occupancy_frames IS NULL) AS no_feature, count(*) FILTER (WHERE counting_version = 'count-v2' AND occupancy_frames = 0) AS no_evidence FROM episode GROUP BY 1)
    SELECT cam, CAST(coalesce(len(l), 0) AS BIGINT) AS measured, off_era, no_feature, no_evidence, l[len(l)] AS peak, l[least(len(l), CAST(floor(0.95 * len(l)) AS BIGINT) + 1)] AS p95, {MEDIAN} AS median FROM e""",
)
def ag14_occupancy_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, now = a.episode(spark, sf_dir), F.col("counting_version") == "count-v2"
    counts = e.groupBy("cam").agg(F.count_if(~now).alias("off_era"), F.count_if(now & F.col("occupancy_frames").isNull()).alias("no_feature"), F.count_if(now & (F.col("occupancy_frames") == 0)).alias("no_evidence"))
    r = stats.ranked(e.where(now & (F.col("occupancy_frames") > 0)), ["cam"], "occupancy_max").groupBy("cam").agg(F.max("n").alias("measured"), F.max("v").alias("peak"), stats.nearest_rank(0.95).alias("p95"), stats.nearest_rank(0.5).alias("median"))
    return counts.join(r, "cam", "left").withColumn("measured", F.coalesce("measured", F.lit(0)))


@query(
    "ag20_camera_rollup",
    a.ctes("door", "episode") + """,
    o AS (SELECT cam, ts_us, CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24 AS hour, (ts_us - lag(ts_us) OVER (PARTITION BY cam ORDER BY ts_us, id)) / 1e6 AS headway FROM door WHERE door_state = 'open'),
    r AS (SELECT cam, ts_us, id, door_state, lead(ts_us) OVER (PARTITION BY cam ORDER BY ts_us, id) AS next FROM door),
    m AS (SELECT cam, count(*) AS stops, quantile_cont(headway, 0.5) AS med, quantile_cont(headway, 0.9) AS p90 FROM o GROUP BY 1),
    i AS (SELECT o.cam, count(*) FILTER (WHERE headway > greatest(36000, 3 * med)) AS idle FROM o JOIN m ON m.cam = o.cam GROUP BY 1),
    d AS (SELECT cam, median((next - ts_us) / 1e6) AS dwell FROM r WHERE door_state = 'open' AND next > ts_us GROUP BY 1),
    c AS (SELECT cam, max(occupancy_max) FILTER (WHERE occupancy_frames > 0) AS most FROM episode GROUP BY 1),
    h AS (SELECT cam, string_agg(hour || ':' || n, ',' ORDER BY hour) AS by_hour FROM (SELECT cam, hour, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
    SELECT m.cam, m.stops, round(m.med, 4) AS median_s, round(m.p90, 4) AS p90_s, i.idle, round(d.dwell, 4) AS median_dwell_s, c.most AS most_people, h.by_hour FROM m JOIN i ON i.cam = m.cam LEFT JOIN d ON d.cam = m.cam LEFT JOIN c ON c.cam = m.cam JOIN h ON h.cam = m.cam""",
)
def ag20_camera_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    door = carry.with_day(a.door(spark, sf_dir))
    dwell = carry.first_after(door.select("cam", "ts_us", "id", "door_state", carry.DAY), ["cam"], {"next": F.col("ts_us")}).where("door_state = 'open' AND next > ts_us")
    opens = carry.last_before(door.where("door_state = 'open'"), ["cam"], {"prev": F.col("ts_us")}).withColumn("headway", (F.col("ts_us") - F.col("prev")) / US)
    m = opens.groupBy("cam").agg(F.count("*").alias("stops")).join(stats.ranked(opens, ["cam"], "headway").groupBy("cam").agg(stats.linear(0.5).alias("med"), stats.linear(0.9).alias("p90")), "cam", "left")
    idle = opens.join(F.broadcast(m), "cam").groupBy("cam").agg(F.count_if(F.col("headway") > F.greatest(F.lit(36000), 3 * F.col("med"))).alias("idle"))  # m has a row for each camera
    d = stats.ranked(dwell.withColumn("dwell", (F.col("next") - F.col("ts_us")) / US), ["cam"], "dwell").groupBy("cam").agg(F.round(stats.linear(0.5), 4).alias("median_dwell_s"))
    c = a.episode(spark, sf_dir).where("occupancy_frames > 0").groupBy("cam").agg(F.max("occupancy_max").alias("most_people"))
    hourly = opens.groupBy("cam", cycles.labelled_local_hour(F.col("ts_us")).alias("hour")).agg(F.count("*").alias("n")).groupBy("cam").agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("h"))
    by_hour = hourly.select("cam", F.array_join(F.transform("h", lambda x: F.concat(x["hour"], F.lit(":"), x["n"])), ",").alias("by_hour"))
    out = m.join(idle, "cam").join(d, "cam", "left").join(c, "cam", "left").join(by_hour, "cam")
    return out.select("cam", "stops", F.round("med", 4).alias("median_s"), F.round("p90", 4).alias("p90_s"), "idle", "median_dwell_s", "most_people", "by_hour")


@query(
    "sx17_rtt_check",
    a.ctes("door") + ", " + TRIPS + """,
    dw AS (SELECT cam, door_state, (lead(ts_us) OVER (PARTITION BY cam ORDER BY ts_us, id) - ts_us) / 1e6 AS d FROM door),
    m AS (SELECT cam, count(*) AS opens, median(d) AS dwell FROM dw WHERE door_state = 'open' AND d > 0 AND d < 90000 GROUP BY 1),
    r AS (SELECT cam, count(*) AS trips, median(rtt_s) AS rtt, median(n_stops) AS stops FROM trips GROUP BY 1)
    SELECT r.cam, r.trips, round(r.rtt, 4) AS median_rtt_s, round(r.stops * (m.dwell + 1500), 4) AS explained_s, round(r.stops * (m.dwell + 1500) / r.rtt, 6) AS share, round(r.rtt / 7, 4) AS implied_interval_s FROM r LEFT JOIN m ON m.cam = r.cam""",
)
def sx17_rtt_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the median round trip its stops explain (dwell and five seconds of door and transfer each), and the interval that the fleet's lifts imply."""
    door = carry.first_after(carry.with_day(a.door(spark, sf_dir).select("cam", "ts_us", "id", "door_state")), ["cam"], {"next": F.col("ts_us")})
    d = stats.ranked(door.withColumn("d", (F.col("next") - F.col("ts_us")) / US).where("door_state = 'open' AND d > 0 AND d < 90000"), ["cam"], "d").groupBy("cam").agg(stats.linear(0.5).alias("dwell"))
    t = _trips(spark, sf_dir)
    r = stats.ranked(t, ["cam"], "rtt_s").groupBy("cam").agg(F.max("n").alias("trips"), stats.linear(0.5).alias("rtt")).join(stats.ranked(t, ["cam"], "n_stops").groupBy("cam").agg(stats.linear(0.5).alias("stops")), "cam")
    explained = F.col("stops") * (F.col("dwell") + 1500)
    return r.join(d, "cam", "left").select("cam", "trips", F.round("rtt", 4).alias("median_rtt_s"), F.round(explained, 4).alias("explained_s"), rounded(explained / F.col("rtt")).alias("share"), F.round(F.col("rtt") / 7, 4).alias("implied_interval_s"))
