"""Label admission over the driver's reads, with a statement that settles removals by the parity of chains instead of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import alphabet
from ..registry import query
from ..sources import adapters as a

BY = alphabet.DRIVER
K = "cam, door_version"
ADMISSION_SQL = (
    a.ctes("door", "labelled", "prior").replace("WITH", "WITH RECURSIVE", 1)
    + f""",
r AS (SELECT {K}, ts_us, id, floor, read_conf, CASE WHEN regexp_full_match(trim(floor), '[+-]?[0-9]+') THEN CAST(trim(floor) AS INTEGER) END AS idx FROM door WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')),
p AS (SELECT *, lag(floor) OVER w AS f0, lag(idx) OVER w AS i0, (ts_us - lag(ts_us) OVER w) / 1e6 AS dt FROM r WINDOW w AS (PARTITION BY {K} ORDER BY ts_us, id)),
q AS (SELECT *, abs(idx - i0) / dt <= {BY.speed} AS plausible FROM p WHERE idx IS NOT NULL AND i0 IS NOT NULL AND dt > 0),
sup AS (SELECT DISTINCT {K}, unnest([f0, floor]) AS floor FROM q WHERE plausible),
edge AS (SELECT DISTINCT {K}, unnest([f0, floor]) AS x, unnest([floor, f0]) AS y FROM q WHERE plausible AND dt <= {BY.edge_s}),
flip AS (
  SELECT {K}, unnest([f0, floor]) AS floor, unnest([floor, f0]) AS image, ts_us, id FROM q
  WHERE NOT plausible AND dt <= {BY.flip_s} AND abs(idx - i0) >= {BY.flip_gap}
    AND CASE WHEN length(f0) = length(floor) THEN len(list_filter(range(1, length(floor) + 1), lambda i: f0[i] <> floor[i])) = 1 ELSE f0 = '1' || floor OR floor = '1' || f0 END),
twins AS (SELECT {K}, floor, any_value(first) AS twin, count(*) FILTER (image = first) AS flips FROM (SELECT *, first_value(image) OVER (PARTITION BY {K}, floor ORDER BY ts_us, id) AS first FROM flip) GROUP BY {K}, floor),
node AS (SELECT {K}, floor, any_value(idx) AS idx, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, avg(read_conf) AS conf FROM r GROUP BY {K}, floor),
reach AS (SELECT {K}, floor, floor AS far FROM node WHERE idx IS NOT NULL UNION SELECT reach.cam, reach.door_version, reach.floor, edge.y FROM reach JOIN edge ON edge.cam = reach.cam AND edge.door_version = reach.door_version AND edge.x = reach.far),
comp AS (SELECT {K}, floor, count(*) AS size, bool_or(far IN (SELECT l.floor FROM labelled l WHERE l.cam = reach.cam)) AS holds FROM reach GROUP BY {K}, floor),
anchors AS (SELECT {K}, bool_or(holds) AS any_anchor FROM comp GROUP BY {K}),
facts AS (
  SELECT n.*, coalesce(t.flips, 0) AS flips, t.twin, s.floor IS NOT NULL AS supported, l.floor IS NOT NULL AS lab,
    CASE WHEN idx IS NOT NULL THEN NOT coalesce(any_anchor, false) OR holds END AS anchored, size
  FROM node n LEFT JOIN twins t USING ({K}, floor) LEFT JOIN sup s USING ({K}, floor) LEFT JOIN comp c USING ({K}, floor) LEFT JOIN anchors USING ({K}) LEFT JOIN labelled l ON l.cam = n.cam AND l.floor = n.floor),
base AS (
  SELECT *, CASE WHEN lab THEN 'labeled' WHEN idx IS NULL THEN 'reject:non_numeric_unlabeled' WHEN NOT supported THEN 'reject:no_transition_support'
    WHEN n < {BY.sightings} THEN 'reject:only_' || n || '_sightings' WHEN anchored THEN 'corroborated' WHEN size = 1 THEN 'corroborated:lone' ELSE 'quarantine:unanchored_island' END AS via0 FROM facts),
cand AS (
  SELECT x.*, y.via0 AS twin_via, NOT x.lab AND x.flips >= {BY.flips} AND x.conf < y.conf AS against FROM base x LEFT JOIN base y ON y.cam = x.cam AND y.door_version = x.door_version AND y.floor = x.twin),
chain AS (
  SELECT {K}, floor, floor AS at, 0 AS depth FROM cand
  UNION ALL SELECT chain.cam, chain.door_version, chain.floor, c.twin, depth + 1 FROM chain JOIN cand c ON c.cam = chain.cam AND c.door_version = chain.door_version AND c.floor = chain.at
  WHERE c.against AND (c.via0 LIKE 'labeled%' OR c.via0 LIKE 'corr%') AND (c.twin_via LIKE 'labeled%' OR c.twin_via LIKE 'corr%')),
depth AS (SELECT {K}, floor, max(depth) AS d FROM chain GROUP BY {K}, floor),
stands AS (SELECT cand.*, d % 2 = 1 AS gone, (via0 LIKE 'labeled%' OR via0 LIKE 'corr%') AND d % 2 = 0 AS stays FROM cand JOIN depth USING ({K}, floor)),
killed AS (
  SELECT x.*, x.gone OR x.via0 LIKE 'quar%' AND x.against AND coalesce(y.stays, false) AS shadow FROM stands x LEFT JOIN stands y ON y.cam = x.cam AND y.door_version = x.door_version AND y.floor = x.twin),
verdict AS (
  SELECT {K}, floor, n, first_us, last_us, supported, anchored, flips, CASE WHEN shadow THEN twin END AS twin, stays AS admitted, CASE WHEN shadow THEN 'quarantine:glyph_shadow_of_' || twin ELSE via0 END AS via FROM killed),
whole AS (
  SELECT v.*, pr.floor IS NOT NULL AND (via LIKE 'reject:non_numeric%' OR via LIKE 'reject:only%') AS back FROM verdict v LEFT JOIN prior pr ON pr.cam = v.cam AND pr.floor = v.floor)
SELECT {K}, floor, n, first_us, last_us, supported, anchored, flips, twin, admitted OR back AS admitted, CASE WHEN back THEN 'retained:' || via ELSE via END AS via FROM whole
UNION ALL
SELECT e.cam, e.door_version, pr.floor, 0, NULL, NULL, false, NULL, 0, NULL, true, 'retained:no_rows' FROM (SELECT DISTINCT {K} FROM node) e JOIN prior pr USING (cam) WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.cam = e.cam AND n.door_version = e.door_version AND n.floor = pr.floor)
"""
)


@query("sx19_label_admission", ADMISSION_SQL)
def sx19_label_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alphabet.admission(a.door(spark, sf_dir), a.declared_floors(spark, a.LABELLED), a.declared_floors(spark, a.PRIOR), BY)
