"""Filters, joins, aggregates, statistics and set operations that are plain SQL in either engine. Durations follow the driver's profile: production seconds times 300."""

from __future__ import annotations

from ..registry import sql_query as q

# scans, predicates, cleansing
q("sc3_door_scan", "SELECT id, cam, ts_us, floor, door_state FROM {door} WHERE gateway_id = 'site-A' AND ts_us >= 1704672000000000 AND ts_us < 1705276800000000")
q("sc4_transit_scan", "SELECT id, cam, ts_us, direction FROM {transit} WHERE ts_us IS NOT NULL AND ts_us >= 1704672000000000")
q("sc7_confident_reads", "SELECT id, cam, door_version, ts_us, floor FROM {door} WHERE floor IS NOT NULL AND coalesce(reason, '') IN ('', 'ok', 'single_panel')")
q(
    "sc9_precision",
    """SELECT cam, count(*) AS n_reviewed, count(*) FILTER (WHERE machine_boarded = human_boarded AND machine_alighted = human_alighted) AS n_exact,
      round(100.0 * count(*) FILTER (WHERE machine_boarded = human_boarded AND machine_alighted = human_alighted) / nullif(count(*), 0), 4) AS precision_pct
    FROM {episode} WHERE status = 'reviewed' GROUP BY cam""",
)
q("sc10_latest_per_camera", "SELECT cam, max(id) AS id, MAXBY(door_state, id) AS door_state, MAXBY(floor, id) AS floor FROM {door} GROUP BY cam")
q("pf2_era_prefix", "SELECT id, cam, door_version FROM {door} WHERE door_version >= 'bbbb2222' AND door_version < 'bbbb2223'")
q("pf3_local_days", "SELECT BUCKET(ts_us + 19800000000, 86400000000) AS local_day, cam, count(*) AS n FROM {door} WHERE ts_us >= 1705170600000000 AND ts_us < 1705775400000000 GROUP BY 1, 2")
q(
    "pf5_not_in_gap",
    """SELECT t.id, t.cam, t.ts_us FROM {transit} t
    WHERE NOT EXISTS (SELECT 1 FROM {gaps} g WHERE t.ts_us >= g.start_us AND t.ts_us < g.end_us AND (g.gap_cam IS NULL OR g.gap_cam = t.cam))""",
)
q("pf6_guard_cut", "SELECT cam, count(*) FILTER (WHERE ts_us < 1704326400000000) AS n_preguard, count(*) FILTER (WHERE ts_us >= 1704326400000000) AS n_kept FROM {door} GROUP BY cam")
q(
    "pf8_label_shape",
    """SELECT floor, CASE WHEN MATCHES(floor, '^(G|LG|UG|B|B1|B2|P[1-9]|M[0-9]?[0-9]?)$') THEN 'named' WHEN NOT MATCHES(floor, '^[0-9]+$') THEN 'shape'
      WHEN CAST(CASE WHEN floor = 'G' THEN '0' ELSE floor END AS INT) <= 30 THEN 'number' WHEN CAST(CASE WHEN floor = 'G' THEN '0' ELSE floor END AS INT) <= 45 THEN 'provisional' ELSE 'too_high' END AS verdict, count(*) AS n
    FROM {door} WHERE floor IS NOT NULL GROUP BY 1, 2""",
)
q("pf9_clean_close", "SELECT cam, count(*) AS n, round(sum(close_travel_s), 4) AS total_s FROM {door} WHERE close_travel_s IS NOT NULL AND coalesce(reason, 'ok') = 'ok' GROUP BY cam")
q(
    "pf10_reject_reason",
    """SELECT id, CASE WHEN read_conf * 20 <= 0.3 THEN 'open_travel_short' WHEN read_conf * 20 >= 15 THEN 'open_travel_long' WHEN k % 11 = 0 THEN 'transfer_negative'
      WHEN close_travel_s <= 1 THEN 'close_travel_short' WHEN close_travel_s >= 30 THEN 'close_travel_long' END AS reject_reason FROM {door} WHERE door_state = 'closing'""",
)
q("pf11_era_kind", "SELECT door_version, split_part(door_version, '+', 1) AS era, door_version LIKE '%h3-state%' AS state_only, count(*) AS n FROM {door} GROUP BY 1, 2, 3")
q(
    "pf12_emit_on_change",
    """SELECT id, cam, ts_us, floor, direction, door_state FROM (
      SELECT *, lag(floor) OVER w AS pf, lag(direction) OVER w AS pd, lag(door_state) OVER w AS ps, row_number() OVER w AS rn FROM {door} WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id))
    WHERE rn = 1 OR floor IS DISTINCT FROM pf OR direction IS DISTINCT FROM pd OR door_state IS DISTINCT FROM ps OR (door_state = 'closing' AND close_travel_s < 50)""",
)
q(
    "pf14_updown_admissible",
    """SELECT cam, door_version, n_confident, n_up, n_down, n_confident > 0 AND n_none = 0 AND n_up > 0 AND n_down > 0 AND greatest(n_up, n_down) <= 0.95 * (n_up + n_down) AS admissible FROM (
      SELECT cam, door_version, count(*) FILTER (WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')) AS n_confident, count(*) FILTER (WHERE direction = 'up') AS n_up,
        count(*) FILTER (WHERE direction = 'down') AS n_down, count(*) FILTER (WHERE direction IS NOT NULL AND reason = 'ambiguous' AND k = 99 AND id % 5 = 0) AS n_none FROM {door} GROUP BY cam, door_version)""",
)
q(
    "pf15_non_regression",
    """WITH prior AS (SELECT DISTINCT cam, floor FROM {door} WHERE door_version = 'aaaa1111h2+g0' AND floor IS NOT NULL),
    now AS (SELECT cam, floor, count(*) AS n FROM {door} WHERE door_version = 'bbbb2222h3-state+g1' AND floor IS NOT NULL GROUP BY cam, floor)
    SELECT coalesce(p.cam, n.cam) AS cam, coalesce(p.floor, n.floor) AS floor, CASE WHEN n.n >= 3 THEN 'admitted' WHEN p.floor IS NOT NULL THEN 'readmitted' ELSE 'absent' END AS verdict
    FROM prior p FULL OUTER JOIN now n ON p.cam = n.cam AND p.floor = n.floor""",
)

# joins
q("jn1_source_join", "SELECT o.o_orderkey AS id, n.n_name AS source, o.o_totalprice AS value FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey")
q(
    "jn15_interval_overlap",
    """SELECT a.id AS a_id, b.id AS b_id FROM {episode} a JOIN {episode} b ON a.cam = b.cam AND a.id < b.id AND BUCKET(a.start_us, 3600000000) BETWEEN BUCKET(b.start_us, 3600000000) - 1 AND BUCKET(b.start_us, 3600000000) + 1
      AND a.start_us < b.end_us AND b.start_us < a.end_us""",
)
q(
    "jn16_minute_correlation",
    """WITH m AS (SELECT cam, BUCKET(ts_us, 21600000000) AS slot, avg(read_conf) AS v FROM {door} GROUP BY 1, 2)
    SELECT a.cam AS cam_a, b.cam AS cam_b, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM m a JOIN m b ON a.slot = b.slot AND a.cam < b.cam GROUP BY 1, 2 HAVING count(*) >= 3""",
)
q("jn17_dimension_left", "SELECT d.cam, c.label, count(*) AS n FROM {door} d LEFT JOIN {channels} c ON d.cam = 'ch' || CAST(c.channel AS STRING) GROUP BY 1, 2")
q(
    "jn14_range_count_hole",
    """WITH j AS (SELECT e.id, d.ts_us FROM {episode} e JOIN {door} d ON d.cam = e.cam AND d.ts_us BETWEEN e.start_us - 3600000000 AND e.end_us + 3600000000),
    g AS (SELECT id, ts_us - lag(ts_us) OVER (PARTITION BY id ORDER BY ts_us) AS gap FROM j)
    SELECT id, count(*) AS n, max(gap) AS hole_us FROM g GROUP BY id""",
)

# aggregates
q(
    "ag3_hour_profile",
    """SELECT cam, hour, sum(n) AS n FROM (
      SELECT cam, BUCKET(ts_us + 19800000000, 3600000000) % 24 AS hour, 1 AS n FROM {transit} UNION ALL
      SELECT cam, BUCKET(start_us + 19800000000, 3600000000) % 24 AS hour, machine_boarded AS n FROM {episode} WHERE machine_boarded > 0) GROUP BY 1, 2""",
)
q(
    "ag6_reason_counts",
    """SELECT cam, door_version, count(*) FILTER (WHERE reason LIKE 'no_%') AS n_no_read, count(*) FILTER (WHERE reason = 'ambiguous') AS n_ambiguous,
      count(*) FILTER (WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')) AS n_confident, count(DISTINCT substr(floor, 1, 1)) AS n_glyphs,
      count(*) FILTER (WHERE direction = 'up') AS n_up, count(*) FILTER (WHERE direction = 'down') AS n_down FROM {door} GROUP BY 1, 2""",
)
q(
    "ag7_coverage_buckets",
    """WITH b AS (SELECT DISTINCT cam, BUCKET(ts_us, 900000000) AS slot FROM (SELECT cam, ts_us FROM {door} UNION ALL SELECT cam, ts_us FROM {transit} UNION ALL SELECT cam, start_us AS ts_us FROM {episode}))
    SELECT cam, BUCKET(slot * 900000000 + 450000000 + 19800000000, 3600000000) AS local_hour, count(*) AS slots FROM b
    WHERE NOT EXISTS (SELECT 1 FROM {gaps} g WHERE slot * 900000000 + 450000000 >= g.start_us AND slot * 900000000 + 450000000 < g.end_us AND (g.gap_cam IS NULL OR g.gap_cam = b.cam)) GROUP BY 1, 2""",
)
q(
    "ag8_totals_today",
    """SELECT cam, sum(CASE WHEN direction = 'in' THEN 1 ELSE 0 END) AS boarded, sum(CASE WHEN direction = 'in' THEN 0 WHEN direction IS NULL THEN 1 ELSE 1 END) AS alighted,
      sum(CASE WHEN direction = 'in' AND ts_us >= 1706553000000000 THEN 1 ELSE 0 END) AS boarded_today, max(nullif(ts_us, 0)) AS last_us FROM {transit} GROUP BY cam""",
)
q("ag17_era_list", "SELECT split_part(door_version, '+', 1) AS era, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us, count(DISTINCT door_version) AS versions FROM {door} GROUP BY 1")
q(
    "ag18_transition_matrix",
    """WITH s AS (SELECT cam, door_version, door_state, lag(door_state) OVER w AS prev, row_number() OVER w AS rn FROM {door} WHERE door_state IS NOT NULL WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id))
    SELECT cam, door_version, prev || '->' || door_state AS step, count(*) AS n FROM s WHERE rn > 1 AND prev <> door_state GROUP BY 1, 2, 3""",
)
q(
    "ag18_funnel",
    """WITH s AS (SELECT cam, door_version, door_state, lag(door_state) OVER w AS prev FROM {door} WHERE door_state IS NOT NULL WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id)),
    f AS (SELECT cam, door_version, count(*) FILTER (WHERE door_state = 'opening' AND prev IS DISTINCT FROM 'opening') AS opening, count(*) FILTER (WHERE door_state = 'open' AND prev = 'opening') AS opened,
      count(*) FILTER (WHERE door_state = 'closing' AND prev = 'open') AS closing, count(*) FILTER (WHERE door_state = 'closed' AND prev = 'closing') AS closed FROM s GROUP BY 1, 2)
    SELECT *, opening - opened AS lost_opening, round(100.0 * closed / nullif(opening, 0), 4) AS yield_pct FROM f""",
)
q(
    "ag19_change_census",
    """WITH c AS (SELECT cam, ts_us, floor IS DISTINCT FROM lag(floor) OVER w AS f, direction IS DISTINCT FROM lag(direction) OVER w AS d, door_state IS DISTINCT FROM lag(door_state) OVER w AS s, ts_us - lag(ts_us) OVER w AS gap
      FROM {door} WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id))
    SELECT cam, count(*) FILTER (WHERE f) AS floor_changes, count(*) FILTER (WHERE d) AS direction_changes, count(*) FILTER (WHERE s) AS state_changes, count(*) FILTER (WHERE gap < 300000000) AS short_gaps FROM c GROUP BY cam""",
)
q("ag21_derived_precision", "SELECT cam, counting_version, count(*) AS reviewed, count(*) FILTER (WHERE human_boarded = machine_boarded AND human_alighted = machine_alighted) AS exact, count(*) >= 20 AS may_go_live FROM {episode} WHERE status = 'reviewed' GROUP BY 1, 2")
q(
    "ag27_boundaries",
    """SELECT e.cam AS lift, e.version, e.from_us, count(*) FILTER (WHERE t.ts_us < e.from_us) AS rows_before, count(*) FILTER (WHERE t.ts_us >= e.from_us) AS rows_after
    FROM {epochs} e JOIN {transit} t ON (e.cam IS NULL OR e.cam = t.cam) WHERE e.from_us > 1704067200000000 AND e.from_us <= 1706659200000000 GROUP BY 1, 2, 3""",
)
q(
    "ag28_glyph_audit",
    """WITH g AS (SELECT cam, UNNEST(SPLITCHARS(floor)) AS glyph, read_conf < 0.2 AS quarantined FROM {door} WHERE floor IS NOT NULL)
    SELECT cam, glyph, count(*) AS n_before, count(*) FILTER (WHERE NOT quarantined) AS n_after, count(*) FILTER (WHERE NOT quarantined) = 0 AS lost, count(*) FILTER (WHERE NOT quarantined) = 1 AS thin, count(*) FILTER (WHERE NOT quarantined) >= 3 AS admissible
    FROM g WHERE glyph <> '' GROUP BY 1, 2""",
)
q("ag30_by_bank", "SELECT CASE WHEN cam IN ('ch16', 'ch27', 'ch29') THEN 'A' ELSE 'B' END AS bank, count(*) AS crossings, count(DISTINCT cam) AS lifts FROM {transit} GROUP BY 1")
q("ag31_agreement", "SELECT door_state, count(*) FILTER (WHERE read_conf > 0.85) AS extreme_open, count(*) FILTER (WHERE read_conf < 0.15) AS extreme_closed, count(*) FILTER (WHERE read_conf BETWEEN 0.15 AND 0.85) AS uncertain FROM {door} GROUP BY door_state")
q(
    "ag32_shared_ranges",
    """WITH r AS (SELECT cam, min(CASE WHEN floor <> 'G' THEN CAST(CASE WHEN floor = 'G' THEN '0' ELSE floor END AS INT) END) AS lo, max(CASE WHEN floor <> 'G' THEN CAST(CASE WHEN floor = 'G' THEN '0' ELSE floor END AS INT) END) AS hi FROM {door} GROUP BY cam)
    SELECT cam, lo, hi, count(*) OVER (PARTITION BY lo, hi) - 1 AS shared_with FROM r""",
)

# windows
q("wn1_open_edges", "SELECT id, cam, ts_us FROM (SELECT id, cam, ts_us, door_state, lag(door_state) OVER (PARTITION BY cam ORDER BY ts_us, id) AS prev FROM {door}) WHERE door_state = 'open' AND (prev IS NULL OR prev <> 'open')")
q(
    "wn9_trailing_peak",
    """WITH r AS (SELECT cam, ts_us, id, count(*) OVER (PARTITION BY cam ORDER BY ts_us RANGE BETWEEN 89999999999 PRECEDING AND CURRENT ROW) AS n FROM {transit})
    SELECT cam, n AS peak, min(ts_us) AS at_us FROM r WHERE n = (SELECT max(n) FROM r r2 WHERE r2.cam = r.cam) GROUP BY 1, 2""",
)
q(
    "wn11_speed_segments",
    """WITH m AS (SELECT cam, door_version, ts_us, id, CASE WHEN floor = 'G' THEN 0 ELSE CAST(CASE WHEN floor = 'G' THEN '0' ELSE floor END AS INT) END AS f FROM {door} WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel')),
    p AS (SELECT cam, door_version, f - lag(f) OVER w AS df, (ts_us - lag(ts_us) OVER w) / 300000000.0 AS dt FROM m WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id))
    SELECT cam, door_version, count(*) FILTER (WHERE df > 0 AND df / dt <= 3) AS up_segments, count(*) FILTER (WHERE df < 0 AND -df / dt <= 3) AS down_segments, count(*) FILTER (WHERE abs(df) / dt > 3) AS too_fast,
      round(avg(CASE WHEN df <> 0 AND abs(df) / dt <= 3 THEN abs(df) / dt END), 6) AS mean_speed FROM p WHERE dt > 0 GROUP BY 1, 2""",
)
q(
    "wn17_duplicate_opens",
    """WITH o AS (SELECT cam, ts_us, id, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY cam ORDER BY ts_us, id) < 3600000000 THEN 0 ELSE 1 END AS starts FROM {door} WHERE door_state = 'open'),
    c AS (SELECT cam, sum(starts) OVER (PARTITION BY cam ORDER BY ts_us, id) AS cluster FROM o), n AS (SELECT cam, cluster, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT cam, count(*) AS clusters, count(*) FILTER (WHERE n = 1) AS singletons, max(n) AS largest FROM n GROUP BY cam""",
)
q(
    "wn16_oscillations",
    """WITH s AS (SELECT cam, ts_us, id, door_state, CASE WHEN (door_state = 'open' AND lag(door_state) OVER w = 'closing') OR (door_state = 'closing' AND lag(door_state) OVER w = 'open') THEN 0 ELSE 1 END AS starts FROM {door} WHERE door_state IS NOT NULL WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id)),
    c AS (SELECT cam, sum(starts) OVER (PARTITION BY cam ORDER BY ts_us, id) AS chain FROM s), n AS (SELECT cam, chain, count(*) AS n FROM c GROUP BY 1, 2)
    SELECT cam, count(*) AS chains, max(n) AS longest FROM n WHERE n >= 3 GROUP BY cam""",
)
q(
    "wn18_running_band",
    """SELECT cam, id, n, round(m + 1e-7, 3) AS mean_s, round(1e-7 + CASE WHEN n > 1 THEN 1.959963984540054 * sqrt(greatest(0.0, (s2 - n * m * m) / (n - 1)) / n) END, 2) AS half_width FROM (
      SELECT cam, id, count(*) OVER w AS n, avg(close_travel_s) OVER w AS m, sum(close_travel_s * close_travel_s) OVER w AS s2 FROM {door} WHERE door_state = 'closing' WINDOW w AS (PARTITION BY cam ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
)
q("sr7_sequence_gaps", "SELECT cam, count(*) AS holes, sum(d - 1) AS missing FROM (SELECT cam, id - lag(id) OVER (PARTITION BY cam ORDER BY id) AS d FROM {door}) WHERE d > 1 GROUP BY cam")
q(
    "sr12_floor_age",
    """SELECT id, cam, LASTNN(floor) OVER w AS carried, round((ts_us - LASTNN(CASE WHEN floor IS NOT NULL THEN ts_us END) OVER w) / 1000000.0, 3) AS floor_age_s FROM {door}
    WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)

# order, sets
q("so1_newest", "SELECT id, cam, ts_us FROM {door} ORDER BY ts_us DESC, id DESC LIMIT 500")
q("so2_newest_version", "SELECT cam, MAXBY(door_version, ts_us) AS door_version, max(ts_us) AS ts_us FROM {door} GROUP BY cam")
q(
    "so3_mode_floor",
    """WITH c AS (SELECT cam, floor, count(*) AS n FROM {door} WHERE floor IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY n DESC, floor) AS rn, sum(n) OVER (PARTITION BY cam) AS total FROM c)
    SELECT cam, floor, round(n / DOUBLED(total), 6) AS share FROM r WHERE rn = 1""",
)
q(
    "so4_era_resolution",
    """WITH p AS (SELECT 'aaaa' AS prefix UNION ALL SELECT 'bbbb2222' UNION ALL SELECT 'cccc'), v AS (SELECT DISTINCT door_version FROM {door})
    SELECT p.prefix, count(v.door_version) AS matches, CASE WHEN count(v.door_version) = 1 THEN max(v.door_version) END AS resolved, CASE WHEN count(v.door_version) > 1 THEN 'ambiguous' WHEN count(v.door_version) = 0 THEN 'unknown' END AS error
    FROM p LEFT JOIN v ON substr(v.door_version, 1, length(p.prefix)) = p.prefix GROUP BY p.prefix""",
)
q("so6_stream_union", "SELECT cam, ts_us, 1 AS n FROM {transit} WHERE direction = 'in' UNION ALL SELECT cam, start_us AS ts_us, machine_boarded AS n FROM {episode} WHERE machine_boarded > 0")
q("so7_raw_log", "SELECT 'cycle' AS kind, cam, ts_us, floor, CAST(NULL AS STRING) AS direction FROM {door} WHERE door_state = 'closed' UNION ALL SELECT 'transit', cam, ts_us, CAST(NULL AS STRING), direction FROM {transit}")
q("so8_days_seen", "SELECT cam, BUCKET(ts_us, 86400000000) AS day FROM {door} UNION SELECT cam, BUCKET(ts_us, 86400000000) AS day FROM {transit}")
q("so10_unmatched", "SELECT cam, ts_bucket FROM {transit} WHERE direction = 'in' EXCEPT SELECT cam, ts_bucket FROM {transit} WHERE direction = 'out'")

# scalar functions
q("sf3_local_clock", "SELECT id, BUCKET(ts_us + 19800000000, 86400000000) AS local_day, BUCKET(ts_us + 19800000000, 3600000000) % 24 AS local_hour, (BUCKET(ts_us + 19800000000, 86400000000) + 3) % 7 AS weekday FROM {door}")
q("sf5_era_keys", "SELECT DISTINCT door_version, coalesce(nullif(split_part(door_version, '+', 1), ''), 'unversioned') AS era FROM {door}")
q("sf6_label_number", "SELECT floor, TRY_CAST(floor AS INT) AS number, count(*) AS n FROM {door} GROUP BY 1, 2")
q(
    "sf7_one_edit_images",
    """WITH f AS (SELECT DISTINCT floor FROM {door} WHERE floor IS NOT NULL)
    SELECT a.floor AS a, b.floor AS b FROM f a JOIN f b ON a.floor <> b.floor AND (a.floor = '1' || b.floor OR b.floor = '1' || a.floor OR
      (length(a.floor) = length(b.floor) AND length(a.floor) <= 2 AND (CASE WHEN substr(a.floor, 1, 1) <> substr(b.floor, 1, 1) THEN 1 ELSE 0 END) + (CASE WHEN substr(a.floor, 2, 1) <> substr(b.floor, 2, 1) THEN 1 ELSE 0 END) = 1))""",
)
q(
    "sf11_histogram",
    """SELECT cam, CASE WHEN close_travel_s < 1 THEN '00-01' WHEN close_travel_s < 2 THEN '01-02' WHEN close_travel_s < 4 THEN '02-04' WHEN close_travel_s < 8 THEN '04-08' WHEN close_travel_s < 16 THEN '08-16' WHEN close_travel_s < 30 THEN '16-30' ELSE '30+' END AS bin, count(*) AS n
    FROM {door} WHERE close_travel_s IS NOT NULL GROUP BY 1, 2""",
)
q("sf18_content_hash", "SELECT id, SHA256(cam || '|' || coalesce(floor, '') || '|' || door_version) AS digest FROM {door} WHERE door_state = 'open'")

# statistics
q(
    "sx1_mean_interval",
    """SELECT cam, door_version, count(*) AS n, round(avg(close_travel_s), 5) AS mean_s, round(CASE WHEN count(*) > 1 THEN avg(close_travel_s) - 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) END, 5) AS lo,
      round(CASE WHEN count(*) > 1 THEN avg(close_travel_s) + 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) END, 5) AS hi FROM {door} WHERE door_state = 'closing' GROUP BY 1, 2""",
)
q(
    "sx3_wilson",
    """WITH c AS (SELECT cam, DOUBLED(count(*)) AS n, DOUBLED(count(*) FILTER (WHERE close_travel_s > 30)) AS k FROM {door} WHERE door_state = 'closing' GROUP BY cam)
    SELECT cam, n, k, round(greatest(0.0, 100 * (k / n + 1.9207294104344544 / n - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 0.9603647052172272 / (n * n))) / (1 + 3.841458820868909 / n)), 4) AS lo_pct,
      round(least(100.0, 100 * (k / n + 1.9207294104344544 / n + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 0.9603647052172272 / (n * n))) / (1 + 3.841458820868909 / n)), 4) AS hi_pct FROM c""",
)
q(
    "sx7_resolution_suppression",
    """SELECT cam, count(*) AS n, round(avg(CASE WHEN abs(close_travel_s - 10 * round(close_travel_s / 10)) <= 1 THEN DOUBLED(1) ELSE DOUBLED(0) END), 6) AS near_quantum, avg(CASE WHEN abs(close_travel_s - 10 * round(close_travel_s / 10)) <= 1 THEN 1.0 ELSE 0.0 END) > 0.2 AS suppressed FROM {door} WHERE door_state = 'closing' GROUP BY cam""",
)
q(
    "sx8_spearman",
    """WITH r AS (SELECT cam, rank() OVER (PARTITION BY cam ORDER BY read_conf) + (count(*) OVER (PARTITION BY cam, read_conf) - 1) / 2.0 AS a, rank() OVER (PARTITION BY cam ORDER BY close_travel_s) + (count(*) OVER (PARTITION BY cam, close_travel_s) - 1) / 2.0 AS b FROM {door} WHERE close_travel_s IS NOT NULL)
    SELECT cam, count(*) AS n, round(corr(DOUBLED(a), DOUBLED(b)), 6) AS rho FROM r GROUP BY cam HAVING count(*) >= 3""",
)
q("sx9_pearson", "SELECT cam, count(*) AS n, round(corr(read_conf, close_travel_s), 6) AS r FROM {door} GROUP BY cam HAVING count(*) >= 3")
q(
    "sx10_auc",
    """WITH c AS (SELECT cam, read_conf AS v, count(*) FILTER (WHERE door_state = 'open') AS p, count(*) FILTER (WHERE door_state = 'closed') AS n FROM {door} WHERE door_state IN ('open', 'closed') GROUP BY 1, 2),
    w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cam ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
    SELECT cam, sum(p) AS positives, sum(n) AS negatives, round(sum(p * (DOUBLED(below) + n / DOUBLED(2))) / nullif(DOUBLED(sum(p)) * sum(n), 0), 6) AS auc FROM w GROUP BY cam""",
)
q(
    "sx12_estimator_scores",
    """SELECT cam, count(*) AS n, round(corr(read_conf * 100, close_travel_s), 6) AS r, round(avg(abs(read_conf * 100 - close_travel_s)), 5) AS mae, round(avg(abs(2.03 - close_travel_s)), 5) AS constant_mae, avg(abs(read_conf * 100 - close_travel_s)) < avg(abs(2.03 - close_travel_s)) AS beats_constant, round(avg(read_conf * 100 - close_travel_s), 5) AS bias, round(PCT(abs(read_conf * 100 - close_travel_s), 0.5), 5) AS median_abs FROM {door} GROUP BY cam""",
)
q(
    "sx15_confidence_level",
    """SELECT cam, n, CASE WHEN n >= 100 AND abs(m - 30) > h THEN 'HIGH' WHEN n >= 30 THEN 'MEDIUM' ELSE 'TOO EARLY' END AS level, CASE WHEN m - h > 30 THEN 'above' WHEN m + h < 30 THEN 'below' ELSE 'straddles' END AS verdict FROM (
      SELECT cam, count(*) AS n, avg(close_travel_s) AS m, 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) AS h FROM {door} WHERE door_state = 'closing' GROUP BY cam)""",
)
q("sk2_transit_dedup", "SELECT gateway_id, cam, track_id, direction, ts_bucket, min(id) AS id FROM {transit} GROUP BY 1, 2, 3, 4, 5")
q("sk3_latest_state", "SELECT gateway_id, cam, MAXBY(door_state, id) AS state, max(id) AS id, count(DISTINCT BUCKET(ts_us, 60000000)) AS history_rows FROM {door} GROUP BY 1, 2")
q("sk4_derived_close", "SELECT id, CASE WHEN reason = 'ok' THEN round(close_travel_s - read_conf, 3) END AS close_travel_s FROM {door} WHERE door_state = 'closing' AND close_travel_s IS NOT NULL")
