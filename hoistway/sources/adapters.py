"""Lift streams made from the driver's tables by projection alone, and the same projections as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GATEWAY = "site-A"
#: Cameras of the fleet, in the order of user_id modulo 7.
CAMS = (16, 27, 29, 30, 32, 34, 37)
#: Declared: the numbers that some cameras' floors lie within; others admit every number.
FLOOR_RANGES = {"ch16": (1, 40), "ch27": (5, 60), "ch30": (1, 9)}
US = 1_000_000
DAY_US = 86_400 * US
#: Fixed value: the building's clock, UTC+05:30 without daylight saving.
LOCAL_US = 19_800 * US
EPOCH = 1_704_067_200 * US  # 2024-01-01 UTC, the first day of the events


def _day(n: int) -> int:
    return EPOCH + (n - 1) * DAY_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    cams = F.array(*[F.lit(f"ch{c}") for c in CAMS])
    return e.select(
        F.col("event_id").alias("id"),
        F.lit(GATEWAY).alias("gateway_id"),
        F.get(cams, (F.col("user_id") % 7).cast("int")).alias("cam"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        "event_type",
        "value",
        "user_id",
    )


def door(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    states = {"view": "closed", "click": "opening", "purchase": "open", "error": "closing"}
    state = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])[F.col("event_type")]
    return e.select(
        "id",
        "gateway_id",
        "cam",
        "ts_us",
        F.when(F.col("k") < 20, "G").when(F.col("k") < 80, (F.col("k") - 19).cast("string")).alias("floor"),
        F.when(F.col("k") % 3 == 0, "up").when(F.col("k") % 3 == 1, "down").alias("direction"),
        state.alias("door_state"),
        ((F.col("k") + 1) / 100.0).alias("read_conf"),
        F.when(F.col("k") < 80, F.when(F.col("k") % 2 == 0, "ok").otherwise("single_panel")).when(F.col("k") < 90, "no_read").otherwise("ambiguous").alias("reason"),
        F.col("value").alias("close_travel_s"),
        F.when(F.col("ts_us") < _day(11), "aaaa1111h2+g0").when(F.col("ts_us") < _day(21), "bbbb2222h2+g0").otherwise("bbbb2222h3-state+g1").alias("door_version"),
        "k",
    )


def transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup", "error"))
    return e.select(
        "id",
        "gateway_id",
        "cam",
        "ts_us",
        F.floor(F.col("ts_us") / US).alias("ts_bucket"),
        F.when(F.col("event_type") == "purchase", "in").when(F.col("event_type") == "signup", "out").alias("direction"),
        F.col("user_id").alias("track_id"),
    )


def episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = _events(spark, sf_dir).where("event_type = 'click'"), F.col("k")
    boarded, alighted = k % 5, k % 4
    human = lambda machine: F.when(k % 6 == 0, machine + F.when(k % 12 == 0, 1).otherwise(0))
    return e.select(
        "id",
        "gateway_id",
        "cam",
        F.col("ts_us").alias("start_us"),
        (F.col("ts_us") + k * US).alias("end_us"),
        boarded.alias("machine_boarded"),
        alighted.alias("machine_alighted"),
        human(boarded).alias("human_boarded"),
        human(alighted).alias("human_alighted"),
        F.when(k % 10 == 0, None).when(k % 10 == 1, 0).otherwise(k).alias("occupancy_frames"),
        (k % 13).alias("occupancy_max"),
        (k % 7 == 0).alias("occupancy_degraded"),
        F.when(F.col("ts_us") < _day(16), "count-v1").otherwise("count-v2").alias("counting_version"),
        F.when(k % 6 == 0, "reviewed").otherwise("auto").alias("status"),
    )


def gaps(spark: SparkSession) -> DataFrame:
    """Declared outages: start_us, end_us, cam (null: the whole fleet)."""
    rows = [(_day(7), _day(8), None), (_day(12), _day(12) + DAY_US // 2, "ch29"), (_day(12) + DAY_US // 4, _day(13), "ch29"), (_day(20) + DAY_US // 2, _day(20) + DAY_US // 2 + 7_200 * US, "ch16")]
    return spark.createDataFrame(rows, "start_us long, end_us long, gap_cam string")


def version_epochs(spark: SparkSession) -> DataFrame:
    """Declared counting versions: cam (null: fleet), from_us, version."""
    rows = [(None, _day(1), "count-v1"), (None, _day(16), "count-v2"), ("ch27", _day(18), "count-v2b"), ("ch30", _day(10), "count-v1b")]
    return spark.createDataFrame(rows, "cam string, from_us long, version string")


def channels(spark: SparkSession) -> DataFrame:
    """channel, is_lift, label: a blank label stays absent."""
    return spark.createDataFrame([(c, 1, f"lift {i + 1}" if i != 5 else "") for i, c in enumerate(CAMS)], "channel int, is_lift int, label string")


#: Declared floors: cam, floor that a person labelled, and those admitted by an earlier derivation.
LABELLED = (("ch16", "G"), ("ch27", "G"), ("ch27", "12"), ("ch29", "3"), ("ch30", "G"), ("ch30", "40"), ("ch32", "G"), ("ch37", "20"))
PRIOR = (("ch34", "G"), ("ch34", "P1"), ("ch29", "G"), ("ch29", "7"), ("ch16", "8"), ("ch16", "9"))


def declared_floors(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "cam string, floor string")


#: The same streams for DuckDB; a query's SQL starts with "WITH " + the ones it needs, joined by commas.
SQL = {
    "ev": """ev AS (SELECT event_id AS id, 'site-A' AS gateway_id, 'ch' || list_extract([16,27,29,30,32,34,37], CAST(user_id % 7 AS INTEGER) + 1) AS cam,
      epoch_us(ts) AS ts_us, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, event_type, value, user_id FROM events)""",
    "door": """door AS (SELECT id, gateway_id, cam, ts_us, CASE WHEN k < 20 THEN 'G' WHEN k < 80 THEN CAST(k - 19 AS VARCHAR) END AS floor,
      CASE k % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS direction,
      CASE event_type WHEN 'view' THEN 'closed' WHEN 'click' THEN 'opening' WHEN 'purchase' THEN 'open' WHEN 'error' THEN 'closing' END AS door_state,
      (k + 1) / 100.0::DOUBLE AS read_conf, CASE WHEN k < 80 AND k % 2 = 0 THEN 'ok' WHEN k < 80 THEN 'single_panel' WHEN k < 90 THEN 'no_read' ELSE 'ambiguous' END AS reason,
      value AS close_travel_s, CASE WHEN ts_us < {d11} THEN 'aaaa1111h2+g0' WHEN ts_us < {d21} THEN 'bbbb2222h2+g0' ELSE 'bbbb2222h3-state+g1' END AS door_version, k FROM ev)""",
    "transit": """transit AS (SELECT id, gateway_id, cam, ts_us, ts_us // 1000000 AS ts_bucket, CASE event_type WHEN 'purchase' THEN 'in' WHEN 'signup' THEN 'out' END AS direction,
      user_id AS track_id FROM ev WHERE event_type IN ('purchase', 'signup', 'error'))""",
    "episode": """episode AS (SELECT id, gateway_id, cam, ts_us AS start_us, ts_us + k * 1000000 AS end_us, k % 5 AS machine_boarded, k % 4 AS machine_alighted,
      CASE WHEN k % 6 = 0 THEN k % 5 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END END AS human_boarded, CASE WHEN k % 6 = 0 THEN k % 4 + CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END END AS human_alighted,
      CASE WHEN k % 10 = 0 THEN NULL WHEN k % 10 = 1 THEN 0 ELSE k END AS occupancy_frames, k % 13 AS occupancy_max, k % 7 = 0 AS occupancy_degraded,
      CASE WHEN ts_us < {d16} THEN 'count-v1' ELSE 'count-v2' END AS counting_version, CASE WHEN k % 6 = 0 THEN 'reviewed' ELSE 'auto' END AS status FROM ev WHERE event_type = 'click')""",
    "gaps": """gaps AS (SELECT * FROM (VALUES ({d7}, {d8}, NULL), ({d12}, {d12} + 43200000000, 'ch29'), ({d12} + 21600000000, {d13}, 'ch29'), ({d20} + 43200000000, {d20} + 50400000000, 'ch16')) t(start_us, end_us, gap_cam))""",
    "epochs": """epochs AS (SELECT * FROM (VALUES (NULL, {d1}, 'count-v1'), (NULL, {d16}, 'count-v2'), ('ch27', {d18}, 'count-v2b'), ('ch30', {d10}, 'count-v1b')) t(cam, from_us, version))""",
    "channels": """channels AS (SELECT * FROM (VALUES (16, 1, 'lift 1'), (27, 1, 'lift 2'), (29, 1, 'lift 3'), (30, 1, 'lift 4'), (32, 1, 'lift 5'), (34, 1, ''), (37, 1, 'lift 7')) t(channel, is_lift, label))""",
}


SQL["labelled"] = "labelled AS (SELECT * FROM (VALUES " + ", ".join(map(str, LABELLED)) + ") t(cam, floor))"
SQL["prior"] = "prior AS (SELECT * FROM (VALUES " + ", ".join(map(str, PRIOR)) + ") t(cam, floor))"


def ctes(*names: str) -> str:
    """CTEs by name, with what they rest on."""
    needed = [*(["ev"] if {"door", "transit", "episode"} & set(names) else []), *names]
    days = {f"d{n}": str(_day(n)) for n in range(1, 32)}
    out = []
    for n in needed:
        text = SQL[n]
        for d in sorted(days, key=len, reverse=True):
            text = text.replace("{" + d + "}", days[d])
        out.append(text)
    return "WITH " + ",\n".join(out)
