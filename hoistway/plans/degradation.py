"""Degradation verdicts over the driver's sparse streams: the rules of production with fewer openings and reads asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import degradation
from ..operators.demand import DAY_US, HOUR_US
from ..registry import query
from ..sources import adapters as a

NOW, L = a.EPOCH + 28 * DAY_US + 9 * HOUR_US, a.LOCAL_US
BY = degradation.Starvation(recent_h=96.0, opens=1, hours=6, base_hours=12)
READ = degradation.Reading(recent_d=2.0, base_d=5, reads=8, base_days=3, drop=0.02, volume=0.8)
T0, RECENT = NOW - int(BY.history_d * DAY_US), (NOW - int(BY.recent_h * HOUR_US) + L) // HOUR_US * HOUR_US - L


@query(
    "ag22_boardings_per_open",
    a.ctes("door", "transit") + f""",
s AS (SELECT cam, ts_us, door_state, lag(door_state) OVER (PARTITION BY cam ORDER BY ts_us, id) AS prev FROM door WHERE ts_us >= {T0} AND ts_us < {NOW}),
o AS (SELECT cam, (ts_us + {L}) // {HOUR_US} * {HOUR_US} - {L} AS h, count(*) AS o FROM s WHERE door_state = 'open' AND prev IS DISTINCT FROM 'open' GROUP BY ALL),
b AS (SELECT cam, (ts_us + {L}) // {HOUR_US} * {HOUR_US} - {L} AS h, count(*) AS b FROM transit WHERE direction = 'in' AND ts_us >= {T0} AND ts_us < {NOW} GROUP BY ALL),
r AS (SELECT cam, h, coalesce(o, 0) AS o, coalesce(b, 0) AS b, (h + {L}) // {HOUR_US} % 24 AS hod FROM o FULL JOIN b USING (cam, h)),
x AS (SELECT *, hod >= {BY.active[0]} AND hod < {BY.active[1]} AS active, h >= {RECENT} AS late, b / CAST(o AS DOUBLE) AS ratio FROM r),
c AS (SELECT cam, list_sort(list(ratio) FILTER (active AND o >= {BY.opens} AND NOT late)) AS base, list_sort(list(ratio) FILTER (active AND o >= {BY.opens} AND late)) AS rec, count(*) FILTER (active AND o < {BY.opens}) AS n_thin, count(*) FILTER (NOT active) AS n_off FROM x GROUP BY cam),
m AS (SELECT *, CASE WHEN len(base) >= {BY.base_hours} THEN base[len(base) // 2 + 1] END AS baseline FROM c),
u AS (SELECT cam, count(*) AS n, min(h) AS first FROM x JOIN m USING (cam) WHERE active AND o >= {BY.opens} AND late AND ratio < {BY.share} * baseline GROUP BY cam)
SELECT m.cam, CASE WHEN baseline IS NULL THEN 'no baseline' WHEN coalesce(u.n, 0) >= {BY.hours} THEN 'degraded' ELSE 'ok' END AS state, baseline, CASE WHEN baseline IS NOT NULL THEN rec[len(rec) // 2 + 1] END AS recent_median,
  CAST(coalesce(len(base), 0) AS BIGINT) AS n_base, CAST(coalesce(len(rec), 0) AS BIGINT) AS n_recent, CASE WHEN baseline IS NOT NULL THEN coalesce(u.n, 0) END AS n_under, n_thin, n_off, u.first AS first_under_us,
  (SELECT count(DISTINCT door_version) FROM door d WHERE d.cam = m.cam AND d.ts_us >= {T0} AND d.ts_us < {NOW}) AS door_versions FROM m LEFT JOIN u ON u.cam = m.cam""",
)
def ag22_boardings_per_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degradation.starved(a.door(spark, sf_dir), a.transit(spark, sf_dir), NOW, L, BY)


@query(
    "ag23_confidence_baseline",
    a.ctes("door") + f""",
cur AS (SELECT cam, arg_max(door_version, (ts_us, id)) AS era FROM door GROUP BY cam),
d AS (SELECT cam, (ts_us + {L}) // {DAY_US} AS day, count(*) AS n, avg(read_conf) AS conf FROM door JOIN cur USING (cam) WHERE door_version = era AND floor IS NOT NULL AND read_conf IS NOT NULL AND reason IN ('ok', 'single_panel')
  AND ts_us >= {NOW - int(READ.search_d * DAY_US)} AND (ts_us + {L}) // {DAY_US} < {(NOW + L) // DAY_US} GROUP BY ALL),
j AS (SELECT *, day >= {(NOW - int(READ.recent_d * DAY_US) + L) // DAY_US} AS late FROM d),
base AS (SELECT cam, median(conf) AS bc, median(n) AS bn, count(*) AS k FROM (SELECT * FROM j WHERE NOT late AND n >= {READ.reads} QUALIFY row_number() OVER (PARTITION BY cam ORDER BY day DESC) <= {READ.base_d}) GROUP BY cam),
rec AS (SELECT cam, avg(conf) FILTER (late AND n >= {READ.reads}) AS rc, coalesce(sum(n) FILTER (late), 0) AS rn, count(*) FILTER (late) AS rd, count(*) FILTER (n >= {READ.reads}) AS judged FROM j GROUP BY cam),
f AS (SELECT cur.cam, era, coalesce(k, 0) AS n_base, coalesce(k, 0) >= {READ.base_days} AS known, bc, bn, rc, coalesce(rn, 0) AS rn, rd, judged FROM cur LEFT JOIN base USING (cam) LEFT JOIN rec USING (cam)),
v AS (SELECT *, coalesce(known AND bc - rc > {READ.drop}, false) AS fell, coalesce(known AND rd > 0 AND bn > 0 AND rn < {READ.volume} * bn * {max(READ.recent_d, 1)}, false) AS few FROM f)
SELECT cam, era, CASE WHEN rd IS NULL OR NOT known AND rn = 0 AND judged = 0 THEN 'no reads' WHEN NOT known THEN 'baseline building' WHEN fell OR few THEN 'degraded' ELSE 'ok' END AS state, fell AS confidence_fell, few AS volume_fell,
  CASE WHEN known THEN bc END AS base_conf, CASE WHEN known THEN CAST(bn AS DOUBLE) END AS base_reads, rc AS recent_conf, CAST(rn AS BIGINT) AS recent_reads, n_base FROM v""",
)
def ag23_confidence_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degradation.misreading(a.door(spark, sf_dir), NOW, L, READ)
