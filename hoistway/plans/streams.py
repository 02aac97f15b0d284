"""Streaming queries over the events as a file stream; their twins are batch SQL, so batch and stream are held against each other."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters as a
from ..operators.admission import admit_floors
from ..sources.sinks import shared_dir
from ..streaming import jobs, machines
from ..streaming.ingest import DoorIngest, HeartbeatIngest, ingest
from ..streaming.ordered import END_US, Closable, drain
from .sequences import STATE_CYCLES


class _Stream:
    """Reads a table of the driver's folder as a stream, so that the adapters' projections work on it."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def read(self) -> _Stream:
        return self

    def parquet(self, path: str) -> DataFrame:
        return self.spark.readStream.schema(self.spark.read.parquet(path).schema).parquet(f"{path}*")  # a glob: the table may be one file


#: How late a row may come.
LATE_US = 3600 * a.US


@query("sr3_stream_cycles", a.ctes("door") + f", {STATE_CYCLES} SELECT cam, door_version, ts_us, id FROM cyc")
def sr3_stream_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Closable(a.door(_Stream(spark, sf_dir), sf_dir).select("cam", "door_version", "ts_us", "id", "door_state"))
    return drain(jobs.door_cycles(events.rows, LATE_US), [events])


KNOWN = [f"ch{c}" for c in a.CAMS[:6]]
RANGES = ", ".join(f"('{cam}', {lo}, {hi})" for cam, (lo, hi) in a.FLOOR_RANGES.items())
ADMITTED = f"""adm AS (SELECT d.*, floor IS NULL OR floor = 'G' OR regexp_full_match(floor, 'P[0-9]') OR (regexp_full_match(floor, '[0-9][0-9]?') AND (r.cam IS NULL OR TRY_CAST(floor AS INT) BETWEEN r.lo AND r.hi)) AS fits
  FROM door d LEFT JOIN (VALUES {RANGES}) r(cam, lo, hi) ON r.cam = d.cam)"""
FLOOR = "CASE WHEN fits THEN floor END AS floor, CASE WHEN fits THEN reason ELSE 'invalid_label:' || left(floor, 24) END AS reason"


@query("pf7_admit_floor", a.ctes("door") + f", {ADMITTED} SELECT id, {FLOOR} FROM adm")
def pf7_admit_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(cam, *r) for cam, r in a.FLOOR_RANGES.items()], "cam string, lo int, hi int")
    return admit_floors(a.door(spark, sf_dir).select("id", "cam", "floor", "reason"), ranges).select("id", "floor", "reason")


@query(
    "sk1_door_ingest",
    a.ctes("door") + f""", {ADMITTED} SELECT 'doors' AS into, id, cam, ts_us, {FLOOR}, CASE WHEN direction IN ('up', 'down') THEN direction END AS direction, door_state, NULL AS reject FROM adm WHERE cam <> 'ch37'
    UNION ALL SELECT 'rejects', id, cam, ts_us, floor, reason, CASE WHEN direction IN ('up', 'down') THEN direction END, door_state, 'unknown_cam' FROM adm WHERE cam = 'ch37'""",
)
def sk1_door_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door events as a stream into the table of doors and that of rejects; both are read back."""
    sink = DoorIngest(f"{shared_dir(spark)}/doors-{uuid.uuid4().hex}", KNOWN, a.FLOOR_RANGES)
    ingest(a.door(_Stream(spark, sf_dir), sf_dir), sink.write)
    return sink.doors(spark).withColumns({"into": F.lit("doors"), "reject": F.lit(None).cast("string")}).unionByName(sink.rejects(spark).withColumn("into", F.lit("rejects")))


HEARTBEAT_US, KEPT_US = 18_000 * a.US, 14 * a.DAY_US


@query(
    "sk3_heartbeat_ingest",
    a.ctes("door").replace("WITH ", "WITH RECURSIVE ", 1) + f""", o AS (SELECT cam, id, ts_us, row_number() OVER (PARTITION BY cam ORDER BY ts_us, id) AS rn, row_number() OVER (PARTITION BY cam ORDER BY ts_us DESC, id DESC) AS back FROM door),
    h AS (SELECT cam, rn, id, ts_us, ts_us AS kept, true AS keeps FROM o WHERE rn = 1 UNION ALL
      SELECT o.cam, o.rn, o.id, o.ts_us, CASE WHEN o.ts_us - h.kept >= {HEARTBEAT_US} THEN o.ts_us ELSE h.kept END, o.ts_us - h.kept >= {HEARTBEAT_US} FROM h JOIN o ON o.cam = h.cam AND o.rn = h.rn + 1)
    SELECT 'history' AS into, cam, id, ts_us FROM h WHERE keeps AND ts_us // {a.DAY_US} >= (SELECT max(ts_us) - {KEPT_US} FROM door) // {a.DAY_US} UNION ALL SELECT 'current', cam, id, ts_us FROM o WHERE back = 1""",
)
def sk3_heartbeat_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door rows stand for heartbeats: the current state of each camera, and the throttled history of the last 14 days."""
    sink = HeartbeatIngest(f"{shared_dir(spark)}/heartbeats-{uuid.uuid4().hex}", HEARTBEAT_US, KEPT_US)
    ingest(a.door(_Stream(spark, sf_dir), sf_dir).select("id", "cam", "ts_us"), sink.write)
    return sink.current(spark).withColumn("into", F.lit("current")).unionByName(sink.history(spark).withColumn("into", F.lit("history")))


@query("sk2_stream_dedup", a.ctes("transit") + " SELECT gateway_id, cam, track_id, direction, ts_bucket FROM transit GROUP BY ALL")
def sk2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = a.transit(_Stream(spark, sf_dir), sf_dir).withColumn("at", F.timestamp_micros("ts_us"))
    twice = t.unionByName(t)
    return jobs.run_available(jobs.deduplicated(twice).select("gateway_id", "cam", "track_id", "direction", "ts_bucket"))


GAP_US, LONGEST_US = 2400 * a.US, 7500 * a.US
RECORDS = f"""r AS (SELECT cam, ts_us, id, user_id, CASE event_type WHEN 'purchase' THEN 'in' WHEN 'signup' THEN 'out' WHEN 'error' THEN 'out' END AS direction,
  CASE WHEN event_type = 'view' AND k % 10 > 0 THEN k % 5 END AS detections, CASE WHEN event_type = 'view' THEN k % 13 END AS occupancy, 1 AS segments, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS dropped
  FROM ev WHERE event_type IN ('purchase', 'signup', 'error', 'view'))"""
EPISODES = f"""{RECORDS},
o AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY ts_us, id) AS rn FROM r WHERE direction IS NOT NULL),
e AS (SELECT cam, rn, ts_us, id, ts_us AS start_us, 1 AS ep FROM o WHERE rn = 1
  UNION ALL SELECT o.cam, o.rn, o.ts_us, o.id, CASE WHEN o.ts_us - e.ts_us > {GAP_US} OR o.ts_us - e.start_us > {LONGEST_US} THEN o.ts_us ELSE e.start_us END,
    CASE WHEN o.ts_us - e.ts_us > {GAP_US} OR o.ts_us - e.start_us > {LONGEST_US} THEN e.ep + 1 ELSE e.ep END FROM e JOIN o ON o.cam = e.cam AND o.rn = e.rn + 1),
w AS (SELECT r.*, e.ep, last_value(e.ep IGNORE NULLS) OVER x AS of, last_value(e.ts_us IGNORE NULLS) OVER x AS since FROM r LEFT JOIN e ON e.cam = r.cam AND e.id = r.id AND r.direction IS NOT NULL
  WINDOW x AS (PARTITION BY r.cam ORDER BY r.ts_us, r.id ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM w WHERE of IS NOT NULL AND ts_us - since <= {GAP_US}),
g AS (SELECT cam, of, min(ts_us) FILTER (direction IS NOT NULL) AS start_us, max(ts_us) FILTER (direction IS NOT NULL) AS end_us, count(*) FILTER (direction = 'in') AS boarded, count(*) FILTER (direction = 'out') AS alighted,
  count(*) FILTER (direction IS NULL) AS frames, count(detections) AS audited, count(DISTINCT user_id) AS distinct_tracks, coalesce(max(detections), 0) AS det_max, sum(detections) AS det_sum,
  coalesce(max(occupancy), 0) AS occupancy_max, sum(dropped) / CAST(sum(segments + dropped) AS DOUBLE) > {jobs.DEGRADED} AS degraded FROM f GROUP BY cam, of)"""


@query(
    "sr10_audited_episodes",
    a.ctes("transit").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {EPISODES}
    SELECT cam, start_us, end_us, boarded, alighted, frames, distinct_tracks, CAST(det_max AS BIGINT) AS det_max, coalesce(CAST(det_sum AS DOUBLE) / nullif(audited, 0), 0) AS det_mean, CAST(occupancy_max AS BIGINT) AS occupancy_max, degraded,
      CASE WHEN frames = 0 THEN 'no_frames' END AS refused FROM g""",
)
def sr10_audited_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of crossings with the frames analysed in them; views stand for frames."""
    e, k = a._events(_Stream(spark, sf_dir), sf_dir), F.col("k")
    frame = F.col("event_type") == "view"
    records = e.where(F.col("event_type").isin("purchase", "signup", "error", "view")).select(
        "cam", "ts_us", "id", F.when(F.col("event_type") == "purchase", "in").when(~frame, "out").alias("direction"), F.array("user_id").alias("track_ids"),
        F.when(frame & (k % 10 > 0), k % 5).cast("long").alias("detections"), F.when(frame, k % 13).cast("long").alias("occupancy"), F.lit(1).cast("long").alias("segments"), F.when(k % 7 == 0, 1).otherwise(0).cast("long").alias("dropped"),
    )
    records = Closable(records)
    return drain(jobs.audited_episodes(records.rows, GAP_US, LONGEST_US, LATE_US), [records])


@query("sr2_signal_machine")
def sr2_signal_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door cycles from an edge signal; the events' k stands for the sample, a sample's second for 3,600."""
    slow = machines.Edge(debounce=1440 * a.US, longest_gap=54_000 * a.US, shortest_close=1080 * a.US, longest_close=108_000 * a.US)
    samples = Closable(a.door(_Stream(spark, sf_dir), sf_dir).select("cam", "ts_us", "id", F.col("k").cast("double").alias("value")))
    return drain(machines.edge_cycles(samples.rows, LATE_US, slow), [samples])


@query("sr3_signal_states")
def sr3_signal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Door states from a signal; the events' k stands for the sample, a sample's second for 300."""
    slow = machines.Signal(open_hold=120 * a.US, closed_hold=96 * a.US, refractory=1800 * a.US, longest_descent=36_000 * a.US)
    samples = Closable(a.door(_Stream(spark, sf_dir), sf_dir).select("cam", "ts_us", "id", F.col("k").cast("double").alias("value")))
    return drain(machines.door_signal(samples.rows, LATE_US, slow), [samples])


@query(
    "sr8_stream_attribution",
    a.ctes("transit", "episode") + " SELECT t.id, min(e.id) AS episode_id FROM transit t LEFT JOIN episode e ON e.cam = t.cam AND t.ts_us BETWEEN e.start_us - 300000000 AND e.end_us + 300000000 GROUP BY t.id",
)
def sr8_stream_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transits and episodes come as two streams; each transit's episode is known once both have passed it."""
    t = Closable(a.transit(_Stream(spark, sf_dir), sf_dir).select("cam", "id", "ts_us"))
    e = Closable(a.episode(_Stream(spark, sf_dir), sf_dir).select("cam", "id", F.col("start_us").alias("ts_us"), "end_us"), {"cam": "", "end_us": END_US})
    return jobs.attributions(drain(jobs.late_attribution(t.rows, e.rows, 300 * a.US, 100 * a.US, LATE_US, 6 * 3600 * a.US), [t, e]))


SETTLE_US, KEEP_US = 150 * a.US, 3600 * a.US
DETECTIONS = """d AS (SELECT cam, e.id * 3 + p AS id, start_us + (e.id + p) % 3 * 5000000 AS lo, end_us + (e.id + p) % 3 * 5000000 + 60000000 AS hi, end_us + (p * 400 - 200) * 1000000 AS ts_us,
  CASE WHEN e.id % 11 = 0 THEN 'data_hole' WHEN (e.id + p) % 13 = 0 THEN 'low_quality' END AS reason FROM episode e, (SELECT unnest(range(3)) AS p))"""


@query(
    "sr5_stream_commits",
    a.ctes("episode").replace("WITH ", "WITH RECURSIVE ", 1) + f""", {DETECTIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY ts_us, id) AS rn FROM d WHERE ts_us - hi >= {SETTLE_US}),
s AS (
  SELECT cam, 0 AS rn, NULL::BIGINT AS id, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::VARCHAR AS reason, false AS takes, []::BIGINT[][] AS taken, []::BIGINT[][] AS rejected FROM (SELECT DISTINCT cam FROM n)
  UNION ALL
  SELECT cam, rn, id, lo, hi, reason, takes, CASE WHEN takes AND reason IS NULL THEN list_append(taken, [lo, hi]) ELSE taken END, CASE WHEN takes AND reason IS NOT NULL THEN list_append(rejected, [lo, hi]) ELSE rejected END
  FROM (SELECT n.*, s.taken, s.rejected, len(list_filter(s.taken, lambda x: n.lo < x[2] AND x[1] < n.hi)) = 0 AND (n.reason IS NULL OR len(list_filter(s.rejected, lambda x: n.lo < x[2] AND x[1] < n.hi)) = 0) AS takes
    FROM s JOIN n ON n.cam = s.cam AND n.rn = s.rn + 1))
SELECT cam, id, lo, hi, coalesce(reason, 'committed') AS outcome FROM s WHERE takes""",
)
def sr5_stream_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings that three sliding passes detect with edges that drift: each is settled once, a measurement that isn't sound with its reason."""
    e = a.episode(_Stream(spark, sf_dir), sf_dir).withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(3)])))
    drift = (F.col("id") + F.col("pass")) % 3 * 5 * a.US
    seen = e.select("cam", (F.col("id") * 3 + F.col("pass")).alias("id"), (F.col("start_us") + drift).alias("lo"), (F.col("end_us") + drift + 60 * a.US).alias("hi"),
        F.when(F.col("id") % 11 == 0, "data_hole").when((F.col("id") + F.col("pass")) % 13 == 0, "low_quality").alias("reason"), (F.col("end_us") + (F.col("pass") * 400 - 200) * a.US).alias("ts_us"))
    seen = Closable(seen)
    return drain(jobs.committed_intervals(seen.rows, SETTLE_US, KEEP_US, LATE_US), [seen])


@query("sr4_track_transits")
def sr4_track_transits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transits of tracks; a user's events stand for a track's samples, seen a millionth as far apart."""
    k = F.col("k")
    events = a._events(_Stream(spark, sf_dir), sf_dir)
    frames = events.select("cam", F.col("user_id").alias("track_id"), F.floor(F.col("ts_us") / 10_000).alias("ts_us"), F.when(k < 40, "outside").when(k >= 60, "inside").alias("zone"), (k / 100.0).alias("y"))
    return jobs.run_available(machines.track_transits(frames))
