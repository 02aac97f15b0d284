"""Health, ingest state and declared dimensions by the survey's rules. ``now`` is the end of the events (day 31); windows follow the driver's profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import carry, cycles, joins, leftovers
from ..registry import query
from ..registry import sql_query as q
from ..sources import adapters as a
from ..sources import readers

US = a.US
NOW = a._day(31)
HOUR = "CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24"
LIVE_US = 36_000 * US

q("sc9_liveness", f"SELECT cam, max(ts_us) AS last_us, {NOW} - max(ts_us) < {LIVE_US} AS live FROM {{door}} GROUP BY cam")
q("sf8_window_minutes", """SELECT text, CASE WHEN MATCHES(text, '^([01][0-9]|2[0-3]):[0-5][0-9]-([01][0-9]|2[0-3]):[0-5][0-9]$') AND substr(text, 1, 5) < substr(text, 7, 5) THEN CAST(substr(text, 1, 2) AS INT) * 60 + CAST(substr(text, 4, 2) AS INT) END AS from_min,
  CASE WHEN MATCHES(text, '^([01][0-9]|2[0-3]):[0-5][0-9]-([01][0-9]|2[0-3]):[0-5][0-9]$') AND substr(text, 1, 5) < substr(text, 7, 5) THEN CAST(substr(text, 7, 2) AS INT) * 60 + CAST(substr(text, 10, 2) AS INT) END AS to_min, count(*) AS n
  FROM (SELECT lpad(CAST(k % 26 AS STRING), 2, '0') || ':' || lpad(CAST(k % 61 AS STRING), 2, '0') || '-' || lpad(CAST((k * 7) % 24 AS STRING), 2, '0') || ':30' AS text FROM {door}) GROUP BY 1, 2, 3""")  # fmt: skip


@query("sc11_throttle_hex", a.ctes("door") + " SELECT id, cam, k % 16 AS now_flags, CAST(floor(k / 16) AS BIGINT) % 16 AS sticky_flags, k % 16 > 0 AS throttled, k % 2 = 1 AS under_voltage FROM door WHERE ts_us > 1706659200000000 - 172800000000")
def sc11_throttle_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The firmware's mask is a hex text: bits 0-3 are what holds now, bits 16-19 what held since the start."""
    k = F.col("k")
    text = F.concat(F.lit("0x"), F.hex((k % 16) + (F.floor(k / 16) % 16).bitwiseAND(15) * 65536))
    mask = F.conv(F.substring(text, 3, 16), 16, 10).cast("long")
    rows = a.door(spark, sf_dir).where(f"ts_us > {NOW} - 172800000000").withColumn("mask", mask)
    now, sticky = F.col("mask").bitwiseAND(15), F.shiftright(F.col("mask").bitwiseAND(0xF0000), 16)
    return rows.select("id", "cam", now.alias("now_flags"), sticky.alias("sticky_flags"), (now > 0).alias("throttled"), (now.bitwiseAND(1) == 1).alias("under_voltage"))


@query("sf20_hex_masks", a.ctes("door") + " SELECT k % 16 AS now_flags, count(*) AS n, count(*) FILTER (WHERE k % 2 = 1) AS bit0, count(*) FILTER (WHERE CAST(floor(k / 2) AS BIGINT) % 2 = 1) AS bit1, count(*) FILTER (WHERE CAST(floor(k / 16) AS BIGINT) % 2 = 1) AS bit16 FROM door GROUP BY 1")
def sf20_hex_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.hex((F.col("k") % 16) + F.floor(F.col("k") / 16) * 65536)
    mask = a.door(spark, sf_dir).select(F.conv(text, 16, 10).cast("long").alias("m"))
    bit = lambda i: F.count_if(F.expr(f"(shiftright(m, {i}) & 1) = 1"))
    return mask.groupBy(F.col("m").bitwiseAND(15).alias("now_flags")).agg(F.count("*").alias("n"), bit(0).alias("bit0"), bit(1).alias("bit1"), bit(16).alias("bit16"))


@query(
    "sc5_iso_cycles",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey % 7 AS source_id, o_orderkey % 5 AS form, epoch_us(CAST(o_orderdate AS TIMESTAMP)) + 28800000000 - CASE o_orderkey % 5 WHEN 0 THEN 0 ELSE 19800000000 END AS open_us, o_orderkey % 11 - 3 AS dwell, o_orderkey % 7 - 2 AS travel, o_totalprice AS close_travel_s, o_orderpriority AS quality FROM orders)
    SELECT id, 'source ' || source_id AS source, open_us, CASE WHEN travel > 0 THEN CAST(travel AS DOUBLE) END AS open_travel_s, CASE WHEN dwell > 0 THEN CAST(dwell AS DOUBLE) END AS dwell_s, close_travel_s IS NOT NULL AND (quality IS NULL OR quality = '1-URGENT') AS clean
    FROM c WHERE form <> 3 AND open_us >= 820454400000000 AND open_us < 883612800000000""",
)
def sc5_iso_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retired instrument's cycles: ISO texts with and without offset (unreadable ones fall out), sources joined, and the half-open time filter after parsing."""
    o, key = a.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")).cast("long") * 86_400 + 28_800)
    text = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    form = key % 5
    iso = lambda ts: F.when(form == 0, F.concat(text(ts), F.lit("Z"))).when(form == 1, text(ts)).when(form == 2, F.concat(text(ts), F.lit("+0530"))).when(form == 3, "n/a").otherwise(F.concat(text(ts), F.lit("+05:30")))
    later = lambda s: F.timestamp_seconds(F.unix_seconds(at) + s)
    travel, dwell = key % 7 - 2, key % 11 - 3
    events = o.select(key.alias("id"), (F.col("o_custkey") % 7).alias("source_id"), iso(at).alias("open_start"), iso(later(travel)).alias("open_full"), iso(later(travel + dwell)).alias("close_start"), F.col("o_totalprice").alias("close_travel_s"), F.col("o_orderpriority").alias("quality"))
    sources = spark.createDataFrame([(i, f"source {i}") for i in range(7)], "source_id long, source string")
    e = events.join(F.broadcast(sources), "source_id").withColumns({c: readers.iso_to_us(F.col(c)) for c in ("open_start", "open_full", "close_start")})
    positive = lambda hi, lo: F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) / US)
    clean = F.col("close_travel_s").isNotNull() & (F.col("quality").isNull() | (F.col("quality") == "1-URGENT"))
    e = e.where("open_start >= 820454400000000 AND open_start < 883612800000000")
    return e.select("id", "source", F.col("open_start").alias("open_us"), positive("open_full", "open_start").alias("open_travel_s"), positive("close_start", "open_full").alias("dwell_s"), clean.alias("clean"))


# ---- health -----------------------------------------------------------------------------------------------------------------------------------
RECENT, BASE = 3 * a.DAY_US, 14 * a.DAY_US


@query(
    "ag24_health_counters",
    a.ctes("door", "transit") + f""", t AS (SELECT cam, max(ts_us) AS last_us, round(count(*) FILTER (WHERE ts_us >= {NOW} - 1209600000000 AND {HOUR} = CAST(floor(({NOW} + 19800000000) / 3600000000) AS BIGINT) % 24)
        / greatest(1.0, least(14.0, ({NOW} - min(ts_us) FILTER (WHERE ts_us >= {NOW} - 1209600000000 AND {HOUR} = CAST(floor(({NOW} + 19800000000) / 3600000000) AS BIGINT) % 24)) / 86400000000.0)), 4) AS rate FROM transit GROUP BY 1),
    f AS (SELECT cam, count(*) FILTER (WHERE ts_us < {NOW - RECENT}) AS bn, count(floor) FILTER (WHERE ts_us < {NOW - RECENT}) AS bf, count(*) FILTER (WHERE ts_us >= {NOW - RECENT}) AS rn, count(floor) FILTER (WHERE ts_us >= {NOW - RECENT}) AS rf FROM door WHERE ts_us >= {NOW - BASE} GROUP BY 1)
    SELECT f.cam, round(({NOW} - t.last_us) / 1e6, 0) AS age_s, t.rate AS hourly_rate, bn AS base_n, rn AS recent_n, round(bf / CAST(nullif(bn, 0) AS DOUBLE), 6) AS base_rate, round(rf / CAST(nullif(rn, 0) AS DOUBLE), 6) AS recent_rate,
      coalesce(bn >= 200 AND rn >= 50 AND bf >= 0.2 * bn AND rf / CAST(rn AS DOUBLE) <= 0.25 * bf / bn, false) AS collapsed, coalesce(bn >= 200 AND rn >= 50 AND bf >= 0.2 * bn AND rf / CAST(rn AS DOUBLE) > 0.25 * bf / bn AND rf / CAST(rn AS DOUBLE) <= 0.5 * bf / bn, false) AS degraded
    FROM f LEFT JOIN t ON t.cam = f.cam""",
)
def ag24_health_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of this hour of the day against the last 14 days' rate, and floor reads of the recent window against the base before it."""
    ts = F.col("ts_us")
    same = (ts >= NOW - BASE) & (cycles.labelled_local_hour(ts) == (NOW + a.LOCAL_US) // (3600 * US) % 24)
    days = F.greatest(F.lit(1.0), F.least(F.lit(14.0), (NOW - F.min(F.when(same, ts))) / a.DAY_US))
    t = a.transit(spark, sf_dir).groupBy("cam").agg(F.max("ts_us").alias("last"), F.round(F.count_if(same) / days, 4).alias("hourly_rate"))
    old = ts < NOW - RECENT
    f = a.door(spark, sf_dir).where(ts >= NOW - BASE).groupBy("cam").agg(F.count_if(old).alias("base_n"), F.count(F.when(old, F.col("floor"))).alias("bf"), F.count_if(~old).alias("recent_n"), F.count(F.when(~old, F.col("floor"))).alias("rf"))
    base, recent = F.try_divide("bf", "base_n"), F.try_divide("rf", "recent_n")
    judged = (F.col("base_n") >= 200) & (F.col("recent_n") >= 50) & (base >= 0.2)
    out = f.join(t, "cam", "left").withColumns({"base_rate": base, "recent_rate": recent})
    yes = lambda c: F.coalesce(c, F.lit(False))
    collapsed = yes(judged & (recent <= 0.25 * base))
    return out.select("cam", F.round((NOW - F.col("last")) / US, 0).alias("age_s"), "hourly_rate", "base_n", "recent_n", F.round("base_rate", 6).alias("base_rate"), F.round("recent_rate", 6).alias("recent_rate"), collapsed.alias("collapsed"), (yes(judged & (recent <= 0.5 * base)) & ~collapsed).alias("degraded"))


@query(
    "ag25_health_reasons",
    a.ctes("door", "transit", "episode") + f""", s AS (SELECT cam, door_state, ts_us, id, lag(door_state) OVER (PARTITION BY cam ORDER BY ts_us, id) AS prev, floor FROM door),
    d AS (SELECT cam, max(ts_us) AS last_us, avg(CASE WHEN floor IS NULL THEN 1.0 ELSE 0.0 END) AS dark, count(*) FILTER (WHERE door_state = 'open' AND (prev IS NULL OR prev <> 'open')) / (30 * 24.0) AS opens_hr FROM s GROUP BY 1),
    t AS (SELECT cam, max(ts_us) AS last_us FROM transit GROUP BY 1), e AS (SELECT cam, avg(CASE WHEN occupancy_degraded THEN 1.0 ELSE 0.0 END) AS degraded FROM episode GROUP BY 1)
    SELECT d.cam, concat_ws(',', CASE WHEN {NOW} - d.last_us > 86400000000 THEN 'silent' WHEN {NOW} - d.last_us > {LIVE_US} THEN 'quiet' END, CASE WHEN d.dark >= 0.9 AND d.opens_hr < 1 THEN 'out of service' WHEN d.dark >= 0.2 THEN 'dark floors' END,
        CASE WHEN {NOW} - t.last_us > {LIVE_US} OR t.last_us IS NULL THEN 'no crossings' END, CASE WHEN e.degraded > 0.14 THEN 'frames dropped' END) AS reasons, round(d.opens_hr, 6) AS opens_hr, round(d.dark, 6) AS dark_share
    FROM d LEFT JOIN t ON t.cam = d.cam LEFT JOIN e ON e.cam = d.cam""",
)
def ag25_health_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons that hold for a lift, in the order of their weight; empty if none does."""
    door = carry.last_before(carry.with_day(a.door(spark, sf_dir)), ["cam"], {"before": F.struct("door_state")})
    prev = F.col("before.door_state")
    opens = F.count_if((F.col("door_state") == "open") & (prev.isNull() | (prev != "open")))
    d = door.groupBy("cam").agg(F.max("ts_us").alias("last"), F.avg(F.when(F.col("floor").isNull(), 1.0).otherwise(0.0)).alias("dark"), (opens / 720.0).alias("opens_hr"))
    t = a.transit(spark, sf_dir).groupBy("cam").agg(F.max("ts_us").alias("crossed"))
    e = a.episode(spark, sf_dir).groupBy("cam").agg(F.avg(F.when(F.col("occupancy_degraded"), 1.0).otherwise(0.0)).alias("degraded"))
    age, dark = NOW - F.col("last"), F.col("dark")
    reasons = F.concat_ws(",",
        F.when(age > a.DAY_US, "silent").when(age > LIVE_US, "quiet"),
        F.when((dark >= 0.9) & (F.col("opens_hr") < 1), "out of service").when(dark >= 0.2, "dark floors"),
        F.when((NOW - F.col("crossed") > LIVE_US) | F.col("crossed").isNull(), "no crossings"),
        F.when(F.col("degraded") > 0.14, "frames dropped"))
    return d.join(t, "cam", "left").join(e, "cam", "left").select("cam", reasons.alias("reasons"), F.round("opens_hr", 6).alias("opens_hr"), F.round("dark", 6).alias("dark_share"))


GAPS = """gu AS (SELECT 'ch' || c.channel AS cam, g.start_us AS lo, g.end_us AS hi FROM channels c JOIN gaps g ON g.gap_cam IS NULL OR g.gap_cam = 'ch' || c.channel),
gi AS (SELECT cam, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY cam ORDER BY lo, hi) AS island
  FROM (SELECT *, max(hi) OVER (PARTITION BY cam ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM gu)) GROUP BY cam, island)"""


def declared_gaps(spark: SparkSession) -> DataFrame:
    """cam, lo, hi: the union of a lift's declared outages, as disjoint intervals."""
    g, c = a.gaps(spark), a.channels(spark).select(F.concat(F.lit("ch"), "channel").alias("cam"))
    every = c.join(F.broadcast(g), F.col("gap_cam").isNull() | (F.col("gap_cam") == F.col("cam"))).select("cam", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))  # declared rows, a few
    w = Window.partitionBy("cam").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return every.withColumn("new", (before.isNull() | (F.col("lo") > before)).cast("int")).withColumn("island", F.sum("new").over(w)).groupBy("cam", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


@query(
    "ag2_covered_rates",
    a.ctes("transit", "gaps", "channels") + ", " + GAPS + f""",
    r AS (SELECT cam, CASE WHEN ts_us < {a._day(16)} THEN 'count-v1' ELSE 'count-v2' END AS version, count(*) FILTER (WHERE direction = 'in') AS boarded, count(*) FILTER (WHERE direction IS DISTINCT FROM 'in') AS alighted FROM transit GROUP BY 1, 2),
    v AS (SELECT 'count-v1' AS version, {a._day(1)} AS t0, {a._day(16)} AS t1 UNION ALL SELECT 'count-v2', {a._day(16)}, {NOW}),
    g AS (SELECT gi.cam, v.version, sum(greatest(0, least(hi, t1) - greatest(lo, t0))) AS lost FROM gi, v GROUP BY 1, 2)
    SELECT r.cam, r.version, boarded, alighted, round((t1 - t0 - coalesce(lost, 0)) / 3.6e9, 6) AS covered_h, round((boarded + alighted) / ((t1 - t0 - coalesce(lost, 0)) / 3.6e9), 6) AS per_hour FROM r JOIN v ON v.version = r.version LEFT JOIN g ON g.cam = r.cam AND g.version = r.version""",
)
def ag2_covered_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings an hour of what was covered: the version's range less the union of declared outages."""
    v1 = F.col("ts_us") < a._day(16)
    r = a.transit(spark, sf_dir).groupBy("cam", F.when(v1, "count-v1").otherwise("count-v2").alias("version")).agg(F.count_if(F.col("direction") == "in").alias("boarded"), F.count_if(~F.col("direction").eqNullSafe("in")).alias("alighted"))
    spans = {"count-v1": (a._day(1), a._day(16)), "count-v2": (a._day(16), NOW)}
    inside = lambda t0, t1: F.sum(F.greatest(F.lit(0), F.least("hi", F.lit(t1)) - F.greatest("lo", F.lit(t0))))
    lost = declared_gaps(spark).groupBy("cam").agg(*[inside(*s).alias(v) for v, s in spans.items()])
    span = F.when(F.col("version") == "count-v1", F.lit(spans["count-v1"][1] - spans["count-v1"][0]) - F.coalesce("count-v1", F.lit(0))).otherwise(F.lit(spans["count-v2"][1] - spans["count-v2"][0]) - F.coalesce("count-v2", F.lit(0)))
    out = r.join(F.broadcast(lost), "cam", "left").withColumn("h", span / 3.6e9)  # a row for each lift
    return out.select("cam", "version", "boarded", "alighted", F.round("h", 6).alias("covered_h"), F.round((F.col("boarded") + F.col("alighted")) / F.col("h"), 6).alias("per_hour"))


@query(
    "ag5_single_figures",
    a.ctes("transit", "door") + f""", t AS (SELECT CASE WHEN ts_us < {a._day(16)} THEN 'count-v1' ELSE 'count-v2' END AS version, {HOUR} AS hour FROM transit WHERE direction = 'in'),
    b AS (SELECT version FROM t GROUP BY 1 ORDER BY count(*) DESC, version LIMIT 1), h AS (SELECT t.version, hour, count(*) AS n FROM t JOIN b ON b.version = t.version GROUP BY 1, 2),
    c AS (SELECT cam, count(DISTINCT CAST(floor(ts_us / 3600000000) AS BIGINT)) / 720.0 * 100 AS pct FROM door GROUP BY 1)
    SELECT arg_min(version, struct_pack(a := -n, b := hour)) AS version, arg_min(hour, struct_pack(a := -n, b := hour)) AS busiest_hour, max(n) AS boardings, (SELECT round(min(pct), 6) FROM c WHERE pct > 0) AS coverage_lo, (SELECT round(max(pct), 6) FROM c WHERE pct > 0) AS coverage_hi FROM h""",
)
def ag5_single_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures that stand once in the report: busiest hour of the version with most boardings, and the least and most covered lift."""
    version = F.when(F.col("ts_us") < a._day(16), "count-v1").otherwise("count-v2")
    h = a.transit(spark, sf_dir).where("direction = 'in'").groupBy(version.alias("version"), cycles.labelled_local_hour(F.col("ts_us")).alias("hour")).agg(F.count("*").alias("n"))
    best = h.groupBy("version").agg(F.sum("n").alias("all"), F.max_by(F.struct("hour", "n"), F.struct("n", -F.col("hour"))).alias("top"))
    top = best.agg(F.min_by(F.struct("version", "top"), F.struct(-F.col("all"), "version")).alias("b")).select(F.col("b.version").alias("version"), F.col("b.top.hour").alias("busiest_hour"), F.col("b.top.n").alias("boardings"), F.lit(1).alias("one"))
    c = a.door(spark, sf_dir).groupBy("cam").agg((F.countDistinct(F.floor(F.col("ts_us") / (3600 * US))) / 720.0 * 100).alias("pct")).where("pct > 0").agg(F.round(F.min("pct"), 6).alias("coverage_lo"), F.round(F.max("pct"), 6).alias("coverage_hi"), F.lit(1).alias("one"))
    return top.join(c, "one").drop("one")


SILENCE = 9_000 * US


@query(
    "wn10_suspected_gaps",
    a.ctes("door", "transit", "gaps", "channels") + ", " + GAPS + f""",
    x AS (SELECT cam, ts_us FROM door UNION ALL SELECT cam, ts_us FROM transit),
    live AS (SELECT cam, min(ts_us) AS first, max(ts_us) AS last FROM x GROUP BY 1),
    days AS (SELECT cam, unnest(range(CAST(floor((first + 19800000000) / 86400000000) AS BIGINT), CAST(floor((last + 19800000000) / 86400000000) AS BIGINT) + 1)) AS day FROM live),
    dark AS (SELECT d.cam, d.day * 86400000000 - 19800000000 AS lo, (d.day + 1) * 86400000000 - 19800000000 AS hi FROM days d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.cam = d.cam AND x.ts_us >= d.day * 86400000000 - 19800000000 AND x.ts_us < (d.day + 1) * 86400000000 - 19800000000)),
    long_ AS (SELECT cam, prev AS lo, ts_us AS hi FROM (SELECT cam, ts_us, lag(ts_us) OVER (PARTITION BY cam ORDER BY ts_us) AS prev FROM x) WHERE ts_us - prev >= {SILENCE}),
    told AS (SELECT l.*, (SELECT coalesce(sum(greatest(0, least(l.hi, k.hi) - greatest(l.lo, k.lo))), 0) FROM dark k WHERE k.cam = l.cam) AS in_dark FROM long_ l),
    u AS (SELECT cam, lo, hi, 'silent day' AS kind FROM dark UNION ALL SELECT cam, lo, hi, 'long silence' FROM told WHERE in_dark < 0.5 * (hi - lo)),
    w AS (SELECT u.*, (SELECT coalesce(sum(greatest(0, least(u.hi, g.hi) - greatest(u.lo, g.lo))), 0) FROM gi g WHERE g.cam = u.cam) AS declared FROM u)
    SELECT cam, CAST(lo AS BIGINT) AS from_us, CAST(hi AS BIGINT) AS to_us, kind, CAST(declared AS BIGINT) AS declared_us FROM w WHERE declared < hi - lo - 1000000""",
)
def wn10_suspected_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent local days between live ones, and long silences that silent days don't tell already; what is declared as an outage is left out."""
    door, transit = a.door(spark, sf_dir), a.transit(spark, sf_dir)
    x = carry.with_day(door.select("cam", "ts_us", "id").unionByName(transit.select("cam", "ts_us", "id")))
    local = F.floor((F.col("ts_us") + a.LOCAL_US) / a.DAY_US)
    seen = x.groupBy("cam", local.alias("day")).agg(F.lit(1).alias("one")).drop("one")
    nxt = F.lead("day").over(Window.partitionBy("cam").orderBy("day"))  # a row for each lift and day
    silent = seen.withColumn("next", nxt).where("next > day + 1").withColumn("day", F.explode(F.sequence(F.col("day") + 1, F.col("next") - 1)))
    dark = silent.select("cam", (F.col("day") * a.DAY_US - a.LOCAL_US).alias("lo"), ((F.col("day") + 1) * a.DAY_US - a.LOCAL_US).alias("hi"))
    long = carry.last_before(x, ["cam"], {"prev": F.col("ts_us")}).where(F.col("ts_us") - F.col("prev") >= SILENCE).select("cam", F.col("prev").alias("lo"), F.col("ts_us").alias("hi"))
    long = joins.with_overlap(long, dark, "in_dark", a.DAY_US).where("in_dark < 0.5 * (hi - lo)").drop("in_dark")
    u = dark.withColumn("kind", F.lit("silent day")).unionByName(long.withColumn("kind", F.lit("long silence")))
    out = joins.with_overlap(u, declared_gaps(spark), "declared_us", a.DAY_US)
    return out.where("declared_us < hi - lo - 1000000").select("cam", F.col("lo").alias("from_us"), F.col("hi").alias("to_us"), "kind", "declared_us")


# ---- ingest state and declared dimensions -------------------------------------------------------------------------------------------------------
@query(
    "sk3_heartbeat_history",
    a.ctes("door").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT cam, id, ts_us, row_number() OVER (PARTITION BY cam ORDER BY ts_us, id) AS rn FROM door),
    h AS (SELECT cam, rn, id, ts_us, ts_us AS kept, true AS keeps FROM o WHERE rn = 1 UNION ALL
      SELECT o.cam, o.rn, o.id, o.ts_us, CASE WHEN o.ts_us - h.kept >= 18000000000 THEN o.ts_us ELSE h.kept END, o.ts_us - h.kept >= 18000000000 FROM h JOIN o ON o.cam = h.cam AND o.rn = h.rn + 1)
    SELECT cam, id, ts_us FROM h WHERE keeps AND ts_us >= {NOW} - 1209600000000""",
)
def sk3_heartbeat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history beside the current state: a heartbeat is kept once enough time has passed since the last one kept, and for 14 days."""
    kept = leftovers.throttled(a.door(spark, sf_dir).select("cam", "id", "ts_us"), 18_000 * US)
    return kept.where(f"ts_us >= {NOW} - 1209600000000")


@query(
    "sk5_episode_status",
    a.ctes("episode") + """, s AS (SELECT cam, counting_version, count(*) FILTER (WHERE status = 'reviewed') >= 20 AS live FROM episode GROUP BY 1, 2)
    SELECT e.id, e.cam, CASE WHEN s.live THEN 'auto' ELSE 'pending' END AS status FROM episode e JOIN s ON s.cam = e.cam AND s.counting_version = e.counting_version""",
)
def sk5_episode_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New episodes of a camera whose version has gone live need no review."""
    e = a.episode(spark, sf_dir)
    live = e.groupBy("cam", "counting_version").agg((F.count_if(F.col("status") == "reviewed") >= 20).alias("live"))
    return e.join(F.broadcast(live), ["cam", "counting_version"]).select("id", "cam", F.when(F.col("live"), "auto").otherwise("pending").alias("status"))  # live: a row for each camera and version


@query(
    "sk16_declared_notes",
    a.ctes("door") + """, n AS (SELECT * FROM (VALUES ('aaaa1111h2', 'first engine'), ('bbbb2222h3-state', 'states without openness')) t(era, note)),
    e AS (SELECT split_part(door_version, '+', 1) AS era, count(*) AS n_rows, min(ts_us) AS first_us FROM door GROUP BY 1)
    SELECT e.era, n_rows, first_us, note, note IS NULL AS unexplained FROM e LEFT JOIN n ON n.era = e.era""",
)
def sk16_declared_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eras with the reason declared for their boundary; one without a note says so."""
    notes = spark.createDataFrame([("aaaa1111h2", "first engine"), ("bbbb2222h3-state", "states without openness")], "era string, note string")
    eras = a.door(spark, sf_dir).groupBy(F.split_part("door_version", F.lit("+"), F.lit(1)).alias("era")).agg(F.count("*").alias("n_rows"), F.min("ts_us").alias("first_us"))
    return eras.join(F.broadcast(notes), "era", "left").withColumn("unexplained", F.col("note").isNull())


SPECS = [("ch16", "frames", "operator", 13), ("ch27", "frames", None, 13), ("ch29", "frames", "operator", 13), ("ch30", None, "operator", 13), ("ch32", "weight", "service", 10), ("ch34", "frames", "operator", None), ("ch37", "weight", "service", 10)]

