"""Signals, stops, interval work and exports by the survey's rules; queries over files write what they read into the shared folder first."""

from __future__ import annotations

import contextlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import around, carry, cycles, joins, leftovers, ramps
from ..registry import query
from ..registry import sql_query as q
from ..sources import adapters as a
from ..sources import readers, schemas, sinks
from .sequences import FLAP_CYCLES, HOUR_US, STATE_CYCLES, STOPS, TRIPS, US, _flap_cycles, _stops, _trips

floor_number = lambda c: F.when(F.col(c) == "G", 0).otherwise(F.expr(f"try_cast({c} AS INT)"))


# ---- joins by bucket: their statements stand in marts and more_marts ----------------------------------------------------------------------------
@query("jn15_interval_overlap")
def jn15_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", "id", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    return joins.interval_overlap(e, e, HOUR_US).where("a.id < b.id").select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@query("jn14_range_count_hole")
def jn14_range_count_hole(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", "id", (F.col("start_us") - HOUR_US).alias("lo"), (F.col("end_us") + HOUR_US).alias("hi"))
    return around.holes(a.door(spark, sf_dir).select("cam", "ts_us"), e, 6 * HOUR_US)


@query("wn9_trailing_peak")
def wn9_trailing_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.trailing_peak(a.transit(spark, sf_dir).select("cam", "ts_us"), 25 * HOUR_US)


@query("sr8_late_attribution")
def sr8_late_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = a.episode(spark, sf_dir).select("cam", F.col("id").alias("episode_id"), (F.col("start_us") - 300 * US).alias("lo"), (F.col("end_us") + 300 * US).alias("hi"))
    return joins.point_in_interval(a.transit(spark, sf_dir), e, "lo", "hi", 6 * HOUR_US, "left").groupBy("p.id").agg(F.min("i.episode_id").alias("episode_id"))


@query(
    "sr8_retried_attribution",
    a.ctes("transit", "episode") + """, m AS (SELECT t.id, min(e.id) FILTER (WHERE e.id % 2 = 0) AS early, min(e.id) AS late FROM transit t LEFT JOIN episode e ON e.cam = t.cam AND t.ts_us BETWEEN e.start_us - 300000000 AND e.end_us + 300000000 GROUP BY 1)
    SELECT id, coalesce(early, late) AS episode_id, early IS NULL AND late IS NOT NULL AS retried FROM m""",
)
def sr8_retried_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transits that found no episode when they came (half of them weren't in yet) are tried again later; what is set stays, so a further run changes nothing."""
    t = a.transit(spark, sf_dir).withColumn("episode_id", F.lit(None).cast("long"))
    e = a.episode(spark, sf_dir)
    first = joins.attributed(t, e.where("id % 2 = 0"), 300 * US)
    again = joins.attributed(joins.attributed(first.withColumnRenamed("episode_id", "was").withColumn("episode_id", F.col("was")), e, 300 * US), e, 300 * US)
    return again.select("id", "episode_id", (F.col("was").isNull() & F.col("episode_id").isNotNull()).alias("retried"))


# ---- signals ----------------------------------------------------------------------------------------------------------------------------------
@query(
    "wn19_band_percentiles",
    a.ctes("door") + """, r AS (SELECT id, k, count(*) OVER w AS n, quantile_cont(k, 0.1) OVER w AS lo, quantile_cont(k, 0.9) OVER w AS hi FROM door WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN 599 PRECEDING AND CURRENT ROW))
    SELECT id, CASE WHEN n >= 20 AND hi - lo >= 6 THEN round(least(1.0, greatest(0.0, (k - lo) / (hi - lo))), 6) END AS openness FROM r""",
)
def wn19_band_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openness within the p10..p90 band of the last 600 samples."""
    w = cycles.era_order("cam").rowsBetween(-599, 0)
    r = a.door(spark, sf_dir).select("id", "k", F.count("*").over(w).alias("n"), F.percentile("k", F.array(F.lit(0.1), F.lit(0.9))).over(w).alias("p"))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return r.select("id", F.when((F.col("n") >= 20) & (hi - lo >= 6), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("k") - lo) / (hi - lo))), 6)).alias("openness"))


@query(
    "wn21_stop_speeds",
    a.ctes("door") + """, r AS (SELECT cam, ts_us, id, floor, CASE WHEN floor IS DISTINCT FROM lag(floor) OVER (PARTITION BY cam ORDER BY ts_us, id) THEN 1 ELSE 0 END AS new FROM door WHERE floor IS NOT NULL),
    g AS (SELECT *, sum(new) OVER (PARTITION BY cam ORDER BY ts_us, id) AS run FROM r), s AS (SELECT cam, run, floor, min(ts_us) AS arrive, max(ts_us) AS depart FROM g GROUP BY 1, 2, 3 HAVING max(ts_us) - min(ts_us) >= 600000000),
    p AS (SELECT cam, arrive, CASE WHEN floor = 'G' THEN 0 ELSE TRY_CAST(floor AS INT) END AS f, lag(CASE WHEN floor = 'G' THEN 0 ELSE TRY_CAST(floor AS INT) END) OVER w AS pf, lag(depart) OVER w AS pd FROM s WINDOW w AS (PARTITION BY cam ORDER BY arrive, run))
    SELECT cam, arrive AS arrive_us, abs(f - pf) AS n_floors, round((arrive - pd) / 1e6, 2) AS travel_s, round(abs(f - pf) / ((arrive - pd) / 3e8), 3) AS floors_per_s, CASE WHEN f > pf THEN 'up' ELSE 'down' END AS direction FROM p WHERE f IS NOT NULL AND pf IS NOT NULL AND arrive > pd""",
)
def wn21_stop_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed between consecutive stops; a stop is a run of one floor that dwells."""
    rows = carry.last_before(carry.with_day(a.door(spark, sf_dir).where("floor IS NOT NULL")), ["cam"], {"prev": F.col("floor")})
    rows = carry.total_up_to(rows, ["cam"], {"run": (~F.col("prev").eqNullSafe(F.col("floor"))).cast("int")})
    s = rows.groupBy("cam", "run", "floor").agg(F.min("ts_us").alias("arrive"), F.max("ts_us").alias("depart")).where("depart - arrive >= 600000000").withColumn("f", floor_number("floor"))
    w = Window.partitionBy("cam").orderBy("arrive", "run")  # stops alone, far fewer than rows
    p = s.withColumns({"pf": F.lag("f").over(w), "pd": F.lag("depart").over(w)}).where("f IS NOT NULL AND pf IS NOT NULL AND arrive > pd")
    n, travel = F.abs(F.col("f") - F.col("pf")), (F.col("arrive") - F.col("pd")) / US
    return p.select("cam", F.col("arrive").alias("arrive_us"), n.alias("n_floors"), F.round(travel, 2).alias("travel_s"), F.round(n / (travel / 300), 3).alias("floors_per_s"), F.when(F.col("f") > F.col("pf"), "up").otherwise("down").alias("direction"))


HOLD = 1800 * US


@query(
    "wn22_sustained_closes",
    a.ctes("door") + f""", s AS (SELECT cam, ts_us, id, avg(k) OVER (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v, row_number() OVER (PARTITION BY cam ORDER BY ts_us, id) AS rn FROM door),
    m AS (SELECT *, min(v) OVER (PARTITION BY cam ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {HOLD - 1} FOLLOWING) AS least, min(v) OVER (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN CURRENT ROW AND CURRENT ROW) AS own FROM s),
    e AS (SELECT *, CASE WHEN v < 30.05 THEN 'open' WHEN v >= 60.05 AND NOT EXISTS (SELECT 1 FROM m x WHERE x.cam = m.cam AND x.v < 30.05 AND (x.ts_us > m.ts_us OR (x.ts_us = m.ts_us AND x.id > m.id)) AND x.ts_us < m.ts_us + {HOLD}) THEN 'closed' END AS mark FROM m),
    p AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), first_value(CASE WHEN v >= 60.05 THEN 'closed' ELSE 'open' END) OVER (PARTITION BY cam ORDER BY ts_us, id)) AS state FROM e)
    SELECT cam, ts_us, id FROM p WHERE mark = 'closed' AND state = 'open'""",
)
def wn22_sustained_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes of a smoothed signal with hysteresis: it rises to the upper level while open and doesn't fall below the lower one for the hold."""
    lo, hi = 30.05, 60.05
    rows = carry.with_day(a.door(spark, sf_dir).select("cam", "ts_us", "id", "k"))
    rows = carry.first_after(carry.last_before(rows, ["cam"], {"pk": F.col("k")}), ["cam"], {"nk": F.col("k")})
    total = F.col("k") + F.coalesce("pk", F.lit(0)) + F.coalesce("nk", F.lit(0))
    rows = rows.withColumn("v", total / (1 + F.col("pk").isNotNull().cast("int") + F.col("nk").isNotNull().cast("int")))
    rows = carry.first_after(rows, ["cam"], {"falls": F.when(F.col("v") < lo, F.col("ts_us"))})
    held = F.col("falls").isNull() | (F.col("falls") - F.col("ts_us") >= HOLD)
    mark = F.when(F.col("v") < lo, "open").when((F.col("v") >= hi) & held, "closed").when(F.col("pk").isNull(), F.when(F.col("v") >= hi, "start closed"))
    rows = carry.last_before(rows.withColumn("mark", mark), ["cam"], {"state": F.regexp_replace("mark", "start ", "")})
    first_closed = F.col("pk").isNull() & (F.col("v") >= hi)  # the first sample gives the state to begin with
    return rows.where((F.col("mark") == "closed") & ~first_closed & (F.coalesce("state", F.lit("open")) == "open")).select("cam", "ts_us", "id")


PAD = 90 * US


@query(
    "wn25_edge_validity",
    a.ctes("door", "transit") + "," + FLAP_CYCLES + f""", x AS (SELECT cam, ts_us FROM door UNION ALL SELECT cam, ts_us FROM transit),
    holes AS (SELECT cam, prev AS h0, ts_us AS h1 FROM (SELECT cam, ts_us, lag(ts_us) OVER (PARTITION BY cam ORDER BY ts_us) AS prev FROM x) WHERE ts_us - prev > 5400000000),
    c AS (SELECT cam, door_version, close_us, ts_us, CAST(close_us - close_travel_s * 1000000 AS BIGINT) AS c0, CAST(ts_us + open_travel_s * 1000000 AS BIGINT) AS o1 FROM fc WHERE class = 'clean' AND ts_us IS NOT NULL)
    SELECT cam, door_version, close_us, CASE WHEN o1 IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM holes h WHERE h.cam = c.cam AND ts_us - {PAD} < h1 AND h0 < o1 + {PAD}) END AS open_ok, NOT EXISTS (SELECT 1 FROM holes h WHERE h.cam = c.cam AND c0 - {PAD} < h1 AND h0 < close_us + {PAD}) AS close_ok FROM c""",
)
def wn25_edge_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edge of a cycle on its own: a hole in the merged record spoils the edge it touches (with a pad), not the other one."""
    x = carry.with_day(a.door(spark, sf_dir).select("cam", "ts_us", "id").unionByName(a.transit(spark, sf_dir).select("cam", "ts_us", "id")))
    holes = carry.last_before(x, ["cam"], {"prev": F.col("ts_us")}).where("ts_us - prev > 5400000000").select("cam", F.col("prev").alias("lo"), F.col("ts_us").alias("hi"))
    c = _flap_cycles(spark, sf_dir).where("class = 'clean' AND ts_us IS NOT NULL")
    edge = lambda name, lo, hi: F.struct(F.lit(name).alias("edge"), (lo - PAD).alias("lo"), (hi + PAD).alias("hi"))
    both = F.array(edge("open", F.col("ts_us"), (F.col("ts_us") + F.col("open_travel_s") * US).cast("long")), edge("close", (F.col("close_us") - F.col("close_travel_s") * US).cast("long"), F.col("close_us")))
    edges = c.select("cam", "door_version", "close_us", F.explode(both).alias("e")).select("cam", "door_version", "close_us", "e.*").where("lo IS NOT NULL AND hi IS NOT NULL")
    hit = joins.interval_overlap(edges, holes, a.DAY_US).select("a.cam", "a.door_version", "a.close_us", "a.edge").distinct().withColumn("hit", F.lit(True))
    keys = ["cam", "door_version", "close_us"]
    judged = edges.join(hit, [*keys, "edge"], "left").groupBy(*keys).agg(*[F.max(F.when(F.col("edge") == e, F.col("hit").isNull())).alias(f"{e}_ok") for e in ("open", "close")])
    return judged


@query(
    "sx11_leave_one_out",
    a.ctes("door") + """, c AS (SELECT cam, k AS t, count(*) FILTER (WHERE door_state = 'open') AS p, count(*) FILTER (WHERE door_state <> 'open') AS n FROM door WHERE door_state IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cam ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(p) OVER (PARTITION BY cam ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS acc, sum(p) OVER (PARTITION BY cam) AS tp, sum(n) OVER (PARTITION BY cam) AS tn FROM c),
    o AS (SELECT cam, t AS v, 1 AS y, p AS w, p + n AS here, tp, tn FROM b WHERE p > 0 UNION ALL SELECT cam, t, 0, n, p + n, tp, tn FROM b WHERE n > 0),
    r AS (SELECT o.cam, o.v, o.y, o.w, b.t, row_number() OVER (PARTITION BY o.cam, o.v, o.y ORDER BY b.acc - CASE WHEN o.y = 1 AND o.v >= b.t THEN 1 WHEN o.y = 0 AND o.v < b.t THEN 1 ELSE 0 END DESC, b.t) AS rn FROM o JOIN b ON b.cam = o.cam AND NOT (b.t = o.v AND o.here = 1) WHERE o.tp - o.y > 0 AND o.tn - (1 - o.y) > 0)
    SELECT cam, round(CAST(sum(CASE WHEN (v >= t) = (y = 1) THEN w ELSE 0 END) AS DOUBLE) / (SELECT max(tp + tn) FROM b x WHERE x.cam = r.cam), 6) AS accuracy FROM r WHERE rn = 1 GROUP BY cam""",
)
def sx11_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy when each point is judged by the threshold that the others choose. Only thresholds up to the point or above it change, each by one, so the best of
    either side is a running maximum; cost is linear in the distinct values."""
    c = a.door(spark, sf_dir).where("door_state IS NOT NULL").groupBy("cam", F.col("k").alias("t")).agg(F.count_if(F.col("door_state") == "open").alias("p"), F.count_if(F.col("door_state") != "open").alias("n"))
    own, up = Window.partitionBy("cam"), Window.partitionBy("cam").orderBy("t")
    down = Window.partitionBy("cam").orderBy(F.col("t").desc())
    so_far = lambda w, end: w.rowsBetween(Window.unboundedPreceding, end)
    c = c.withColumns({"acc": F.coalesce(F.sum("n").over(so_far(up, -1)), F.lit(0)) + F.sum("p").over(so_far(down, 0)), "tp": F.sum("p").over(own), "tn": F.sum("n").over(own)})
    c = c.withColumns({"upto": F.max("acc").over(so_far(up, 0)), "before": F.max("acc").over(so_far(up, -1)), "after": F.max("acc").over(so_far(down, -1))})
    none = F.lit(-(1 << 40))
    left = F.coalesce(F.when(F.col("p") + F.col("n") == 1, F.col("before")).otherwise(F.col("upto")), none)
    right = F.coalesce("after", none)
    says_open = lambda y: left - y >= right - (1 - y)  # noqa: E731  of equal ones the smaller threshold, which the point reaches
    allowed = lambda y: (F.col("tp") - y > 0) & (F.col("tn") - (1 - y) > 0)
    right_ones = F.sum(F.when(allowed(1) & says_open(1), F.col("p")).otherwise(0) + F.when(allowed(0) & ~says_open(0), F.col("n")).otherwise(0))
    judged = F.max((F.when(F.col("p") > 0, allowed(1)).otherwise(False)) | F.when(F.col("n") > 0, allowed(0)).otherwise(False))
    return c.groupBy("cam").agg(F.round(right_ones / F.max(F.col("tp") + F.col("tn")), 6).alias("accuracy"), judged.alias("judged")).where("judged").drop("judged")


@query("sr5_committed_intervals")
def sr5_committed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings that sliding windows detect again and again, with edges that drift: each is committed once, when it has settled. Brute force in the tests."""
    e = a.episode(spark, sf_dir).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drift = (F.col("id") + F.col("pass")) % 3 * 5 * US
    seen = e.select("cam", "id", (F.col("start_us") + drift).alias("lo"), (F.col("end_us") + drift + 60 * US).alias("hi"), (F.col("end_us") + (F.col("pass") * 400 - 200) * US).alias("seen_us"))
    return leftovers.committed(seen, 150 * US)


# ---- parts of the walks, each on its own --------------------------------------------------------------------------------------------------------
@query("wn3_cycles_by_era", a.ctes("door") + "," + FLAP_CYCLES + " SELECT cam, split_part(door_version, '+', 1) AS era, class, count(*) AS n, max(close_us) AS last_us FROM fc GROUP BY 1, 2, 3")
def wn3_cycles_by_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle never straddles eras: the walk runs within camera and era."""
    return _flap_cycles(spark, sf_dir).groupBy("cam", F.split_part("door_version", F.lit("+"), F.lit(1)).alias("era"), "class").agg(F.count("*").alias("n"), F.max("close_us").alias("last_us"))


@query("wn5_floor_carry", a.ctes("door") + ", " + TRIPS + " SELECT id, cam, CASE WHEN close = 1 THEN 'close' ELSE 'open' END AS edge, CASE WHEN close = 1 THEN cf ELSE opf END AS floor FROM d2 WHERE close = 1 OR opens = 1")
def wn5_floor_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cycles.carried_floors(a.door(spark, sf_dir)).where("close = 1 OR open")
    closing = F.col("close") == 1
    return rows.select("id", "cam", F.when(closing, "close").otherwise("open").alias("edge"), F.when(closing, F.col("carried")).otherwise(F.col("read")).alias("floor"))


@query("jn10_stop_floors", a.ctes("door") + "," + STOPS + " SELECT cam, floor, count(*) AS n, min(ts_us) AS first_us FROM stops GROUP BY 1, 2")
def jn10_stop_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of a stop by the as-of search both ways; null where no read is near enough."""
    return _stops(spark, sf_dir).groupBy("cam", "floor").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"))


@query("jn11_next_home_open", a.ctes("door") + ", " + TRIPS + " SELECT cam, door_version, ts_us, back_us FROM trips")
def jn11_next_home_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).select("cam", "door_version", "ts_us", "back_us")


RAMP = ramps.Ramp(rise=0.05)


@query("wn23_ramp_estimators")
def wn23_ramp_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the signal k / 100 takes to its closed level in the six hours around each episode, by five estimators anchored at its start."""
    e = a.episode(spark, sf_dir).select("cam", F.col("id").alias("window_id"), F.col("start_us").alias("anchor_us"), (F.col("start_us") - 3 * HOUR_US).alias("lo"), (F.col("start_us") + 3 * HOUR_US).alias("hi"))
    points = a.door(spark, sf_dir).select("cam", "ts_us", (F.col("k") / 100.0).alias("value"))
    return ramps.estimates_around(points, e, RAMP, 6 * HOUR_US)


@query("sx12_ramp_scores")
def sx12_ramp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimators against a duration known otherwise (an episode's length, a second for 100) and against a predictor that always says 5,000 s."""
    hand = a.episode(spark, sf_dir).select(F.col("id").alias("window_id"), ((F.col("end_us") - F.col("start_us")) * 100 / US).alias("hand_s"))
    pairs = wn23_ramp_estimators(spark, sf_dir).join(hand, "window_id").select("estimator", "est_s", "hand_s")
    return ramps.scores(sinks.stored(pairs, "ramps"), 5_000.0, 150.0)


@query("sf1_iso_to_epoch", """WITH t AS (SELECT o_orderkey AS id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS midnight FROM orders)
    SELECT id, CASE id % 6 WHEN 0 THEN midnight + 45296000000 WHEN 1 THEN midnight + 45296000000 - 19800000000 WHEN 2 THEN midnight + 45296000000 + 14400000000 WHEN 3 THEN midnight + 45296500000 - 19800000000 END AS us FROM t""")  # fmt: skip
def sf1_iso_to_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with an offset, without one (the building's clock), with fractions, empty and unreadable."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 6
    text = F.when(kind == 0, F.concat(day, F.lit("T12:34:56Z"))).when(kind == 1, F.concat(day, F.lit("T12:34:56"))).when(kind == 2, F.concat(day, F.lit("T12:34:56-0400"))).when(kind == 3, F.concat(day, F.lit("T12:34:56.5"))).when(kind == 4, "").otherwise("yesterday")
    return a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), readers.iso_to_us(text).alias("us"))


@query("sf2_cli_times", """WITH t AS (SELECT o_orderkey AS id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS midnight FROM orders) SELECT id, CASE id % 3 WHEN 0 THEN midnight - 19800000000 WHEN 1 THEN midnight + 21600000000 - 19800000000 END AS us FROM t""")
def sf2_cli_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds as typed: a day, a day and an hour, or what can't be read; all on the building's clock."""
    day, kind = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    text = F.when(kind == 0, day).when(kind == 1, F.concat(day, F.lit(" 06:00"))).otherwise("6 am")
    return a.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), readers.iso_to_us(text).alias("us"))


# ---- exports and payloads -----------------------------------------------------------------------------------------------------------------------
DAY = "CAST(floor((ts_us + 19800000000) / 86400000000) AS BIGINT)"
q("sk9_export_transits", "SELECT id, cam, ts_us, direction, track_id, CASE WHEN ts_us < 1705363200000000 THEN 'count-v1' ELSE 'count-v2' END AS counting_version FROM {transit}")
q("sk9_export_floor_events", "SELECT id, cam, ts_us, floor, direction, read_conf, reason, split_part(door_version, '+', 1) AS era FROM {door} WHERE floor IS NOT NULL")
q("sk9_export_episodes", "SELECT id, cam, start_us, end_us, machine_boarded, machine_alighted, human_boarded, human_alighted, status, counting_version FROM {episode}")
q("sk9_export_riders_per_day_long", "SELECT BUCKET(ts_us + 19800000000, 86400000000) AS day, cam, CASE WHEN direction = 'in' THEN 'boarded' ELSE 'alighted' END AS what, count(*) AS n FROM {transit} GROUP BY 1, 2, 3")


@query("sk9_export_rtt", a.ctes("door") + ", " + TRIPS + " SELECT cam, split_part(door_version, '+', 1) AS era, ts_us, back_us, rtt_s, n_stops, CASE WHEN rtt_s < 9000 THEN 'short' WHEN rtt_s > 180000 THEN 'long' END AS anomaly FROM trips")
def sk9_export_rtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).select("cam", F.split_part("door_version", F.lit("+"), F.lit(1)).alias("era"), "ts_us", "back_us", "rtt_s", "n_stops", F.when(F.col("rtt_s") < 9000, "short").when(F.col("rtt_s") > 180000, "long").alias("anomaly"))


@query("sk9_export_rtt_per_hour", a.ctes("door") + ", " + TRIPS + f" SELECT cam, {DAY} AS day, CAST(floor((ts_us + 19800000000) / 3600000000) AS BIGINT) % 24 AS hour, count(*) AS trips, round(median(rtt_s), 4) AS median_s FROM trips WHERE rtt_s BETWEEN 9000 AND 180000 GROUP BY 1, 2, 3")
def sk9_export_rtt_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _trips(spark, sf_dir).where("rtt_s BETWEEN 9000 AND 180000")
    t = t.withColumns({"day": F.floor((F.col("ts_us") + a.LOCAL_US) / a.DAY_US), "hour": cycles.labelled_local_hour(F.col("ts_us"))})
    return stats.ranked(t, ["cam", "day", "hour"], "rtt_s").groupBy("cam", "day", "hour").agg(F.max("n").alias("trips"), F.round(stats.linear(0.5), 4).alias("median_s"))


@query("sf15_json_payloads", a.ctes("door") + " SELECT cam, count(*) AS n_rows, count(*) FILTER (WHERE floor IS NOT NULL) AS with_floor, round(sum(close_travel_s), 4) AS total_s, count(DISTINCT reason) AS reasons FROM door GROUP BY 1")
def sf15_json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON texts and back by an explicit schema: nulls stay nulls, and the payload's figures are the rows'."""
    text = a.door(spark, sf_dir).select(F.to_json(F.struct("cam", "floor", "reason", "close_travel_s")).alias("payload"))
    r = text.select(F.from_json("payload", "cam string, floor string, reason string, close_travel_s double").alias("r")).select("r.*")
    return r.groupBy("cam").agg(F.count("*").alias("n_rows"), F.count("floor").alias("with_floor"), F.round(F.sum("close_travel_s"), 4).alias("total_s"), F.countDistinct("reason").alias("reasons"))


def _folder(spark: SparkSession, what: str) -> str:
    return f"{sinks.shared_dir(spark)}/hoistway-{what}-{uuid.uuid4().hex}"


@query("sc14_comment_csv", a.ctes("door") + " SELECT id, cam, floor, close_travel_s, close_travel_s IS NOT NULL AND reason = 'ok' AS timed FROM door WHERE door_state = 'closing'")
def sc14_comment_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus in CSV with notes: header, types and timed (a travel from a clean row)."""
    at = _folder(spark, "csv")
    rows = a.door(spark, sf_dir).where("door_state = 'closing'").select(F.concat_ws(",", "id", "cam", F.coalesce("floor", F.lit("")), F.coalesce(F.col("close_travel_s").cast("string"), F.lit("")), "reason").alias("value"))
    notes = spark.createDataFrame([("# hand-checked",), ("# one row an event",)], "value string")
    notes.unionByName(rows).write.text(at)
    read = readers.comment_csv(spark, at, "id long, cam string, floor string, close_travel_s double, reason string", header=False)
    return read.select("id", "cam", "floor", "close_travel_s", (F.col("close_travel_s").isNotNull() & (F.col("reason") == "ok")).alias("timed"))


@query("sc15_log_samples", a.ctes("door") + " SELECT cam, CAST(floor(ts_us / 60000000) AS BIGINT) AS minute, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM door WHERE k % 3 <> 0 GROUP BY 1, 2")
def sc15_log_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a worker's log, by camera and minute; lines of other forms are passed over."""
    at = _folder(spark, "log")
    line = F.when(F.col("k") % 3 == 0, F.concat(F.lit("[worker] restart "), "cam")).otherwise(F.concat(F.lit("[door "), "cam", F.lit("] t="), "ts_us", F.lit(" depth="), "k"))
    a.door(spark, sf_dir).select(line.alias("value")).write.text(at)
    s = readers.log_samples(spark, at, r"^\[door (ch[0-9]+)\] t=([0-9]+) depth=([0-9]+)$", {"cam": "string", "ts_us": "bigint", "depth": "bigint"})
    return s.groupBy("cam", F.floor(F.col("ts_us") / (60 * US)).alias("minute")).agg(F.count("*").alias("n"), F.sum("depth").alias("total"))


@query("sr13_ndjson_pump", a.ctes("door") + " SELECT cam, count(*) AS good, (SELECT count(*) FROM door WHERE id % 10 = 0) AS bad FROM door WHERE id % 10 <> 0 GROUP BY 1")
def sr13_ndjson_pump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of JSON, one in ten cut off: bad lines are skipped and counted."""
    at = _folder(spark, "ndjson")
    whole = F.to_json(F.struct("id", "cam", "ts_us"))
    a.door(spark, sf_dir).select(F.when(F.col("id") % 10 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value")).write.text(at)
    good, bad = readers.ndjson(spark, at, "id long, cam string, ts_us long")
    return good.groupBy("cam").agg(F.count("*").alias("good")).withColumn("bad", F.lit(bad.count()))


@query("sc16_json_evidence", a.ctes("door") + """, f AS (SELECT DISTINCT cam, floor FROM door WHERE floor IS NOT NULL AND cam <> 'ch37'), g AS (SELECT cam, count(DISTINCT c) AS glyphs FROM (SELECT cam, unnest(string_split(floor, '')) AS c FROM f) WHERE c <> '' GROUP BY 1)
  SELECT 'ch' || channel AS cam, coalesce(g.glyphs, 0) AS glyphs, (SELECT count(*) FROM f WHERE f.cam = 'ch' || channel) AS floors FROM (SELECT unnest([16, 27, 29, 30, 32, 34, 37]) AS channel) c LEFT JOIN g ON g.cam = 'ch' || channel""")  # fmt: skip
def sc16_json_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label evidence in JSON files: glyphs and labelled floors of each camera; a file that can't be read is no evidence."""
    at = _folder(spark, "labels")
    labels = a.door(spark, sf_dir).where("floor IS NOT NULL").groupBy("cam").agg(F.collect_set("floor").alias("labels"))  # as many as a camera has floors
    labels.select(F.when(F.col("cam") == "ch37", '{"cam": "ch37", "labels": [').otherwise(F.to_json(F.struct("cam", "labels"))).alias("value")).write.text(at)
    read = readers.sidecar(spark, at, "cam string, labels array<string>", multi_line=False).select("cam", F.explode("labels").alias("floor"))
    glyphs = read.select("cam", F.explode(F.split("floor", "")).alias("c")).where("c <> ''").groupBy("cam").agg(F.countDistinct("c").alias("glyphs"))
    floors = read.groupBy("cam").agg(F.countDistinct("floor").alias("floors"))
    cams = a.channels(spark).select(F.concat(F.lit("ch"), "channel").alias("cam"))
    return cams.join(glyphs, "cam", "left").join(floors, "cam", "left").select("cam", F.coalesce("glyphs", F.lit(0)).alias("glyphs"), F.coalesce("floors", F.lit(0)).alias("floors"))


@query("sk7_export_with_notes", a.ctes("door") + " SELECT id, cam, floor, close_travel_s, 2 AS notes FROM door WHERE door_state = 'closed'")
def sk7_export_with_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export read again: nulls come back as nulls, and its notes stand beside it."""
    at = _folder(spark, "export")
    sinks.export_csv(a.door(spark, sf_dir).where("door_state = 'closed'").select("id", "cam", "floor", "close_travel_s"), at, ["floors are reads", "times are local"])
    notes = spark.read.text(f"{at}.notes").where("value LIKE '# %'").count()
    return readers.comment_csv(spark, at, "id long, cam string, floor string, close_travel_s double").withColumn("notes", F.lit(notes))


@query("sk10_bundle_manifest", "SELECT * FROM (VALUES ('closes', 'ok', NULL), ('missing', 'unavailable', 'AnalysisException'), ('riders', 'ok', NULL)) t(name, state, reason)")
def sk10_bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of views: the one that fails is named with its reason and the others are whole."""
    views = {
        "closes": lambda: a.door(spark, sf_dir).where("door_state = 'closed'").select("id", "cam"),
        "missing": lambda: spark.read.parquet(f"{sf_dir}/no_such_table.parquet"),
        "riders": lambda: a.transit(spark, sf_dir).groupBy("cam").agg(F.count("*").alias("n")),
    }
    return sinks.bundle(views, _folder(spark, "bundle"), spark).select("name", "state", F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason"))


@query("sk11_raw_cycles", a.ctes("door", "channels") + ", " + STATE_CYCLES + " SELECT c.id, c.cam, c.door_version, c.ts_us, nullif(h.label, '') AS label FROM cyc c LEFT JOIN channels h ON 'ch' || h.channel = c.cam")
def sk11_raw_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cycles with their dimensions as one CSV, read again."""
    at = _folder(spark, "raw")
    label = a.channels(spark).select(F.concat(F.lit("ch"), "channel").alias("cam"), F.nullif("label", F.lit("")).alias("label"))
    c = cycles.state_only_cycles(a.door(spark, sf_dir)).join(F.broadcast(label), "cam", "left")
    sinks.export_csv(c.select("id", "cam", "door_version", "ts_us", "label"), at, [])
    return readers.comment_csv(spark, at, "id long, cam string, door_version string, ts_us long, label string")


@query("sk13_materialised_eras", a.ctes("door") + " SELECT cam, split_part(door_version, '+', 1) AS era, count(*) AS n, 'ok' AS state FROM door WHERE door_version NOT LIKE 'aaaa%' GROUP BY 1, 2 UNION ALL SELECT DISTINCT cam, 'next', NULL, 'pending' FROM door")
def sk13_materialised_eras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates kept by camera and era: written twice they stand once, a retired era is dropped, and one not computed yet is pending, never zero."""
    at, keys = _folder(spark, "eras"), ["cam", "era"]
    rows = a.door(spark, sf_dir).groupBy("cam", F.split_part("door_version", F.lit("+"), F.lit(1)).alias("era")).agg(F.count("*").alias("n"))
    for _ in range(2):
        sinks.materialise(rows, at, keys, 100.0)
    live = rows.where("era NOT LIKE 'aaaa%'").select(*keys)
    sinks.drop_retired(spark, at, keys, live)
    wanted = live.unionByName(live.select("cam", F.lit("next").alias("era")).distinct())
    return sinks.served(spark, at, wanted, keys, 130.0, 60.0).select("cam", "era", "n", "state")


@query("sk14_stale_reads", a.ctes("door") + " SELECT cam, count(*) AS n, 30.0 AS age_s, CASE WHEN cam = 'ch16' THEN 'ok' ELSE 'stale' END AS state FROM door GROUP BY 1".replace("30.0 AS age_s", "CASE WHEN cam = 'ch16' THEN 30.0 ELSE 130.0 END AS age_s"))
def sk14_stale_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stale is served with its age."""
    at = _folder(spark, "stale")
    rows = a.door(spark, sf_dir).groupBy("cam").agg(F.count("*").alias("n"))
    sinks.materialise(rows, at, ["cam"], 0.0)
    sinks.materialise(rows.where("cam = 'ch16'"), at, ["cam"], 100.0)
    return sinks.served(spark, at, rows.select("cam"), ["cam"], 130.0, 60.0).select("cam", "n", "age_s", "state")


@query("sk15_stage_ledger", a.ctes("door", "transit") + " SELECT 'broken' AS stage, CAST(NULL AS BIGINT) AS n_rows, true AS failed, true AS timed UNION ALL SELECT 'door', count(*), false, true FROM door UNION ALL SELECT 'transit', count(*), false, true FROM transit")
def sk15_stage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of three stages, one of which fails: each has a row, its duration and what it wrote."""
    ledger = sinks.RunLedger(spark, _folder(spark, "ledger"))
    ledger.run("door", a.door(spark, sf_dir).count)
    ledger.run("transit", a.transit(spark, sf_dir).count)
    with contextlib.suppress(ZeroDivisionError):
        ledger.run("broken", lambda: 1 // 0)
    return ledger.read(time.time()).select("stage", "n_rows", F.col("error").isNotNull().alias("failed"), (F.col("seconds") >= 0).alias("timed"))
