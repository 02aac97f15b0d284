"""Further filters, aggregates, statistics and findings; see marts.py."""

from __future__ import annotations

from ..registry import sql_query as q

LIMIT = 50  # the cliff of the close travel, in the driver's seconds

q("sc6_episode_features", "SELECT cam, count(*) AS episodes, count(occupancy_frames) AS with_feature, count(occupancy_frames) = 0 AS feature_absent FROM {episode} GROUP BY cam")
q("sc10_last_rows_ascending", "SELECT * FROM (SELECT id, cam, ts_us FROM {door} ORDER BY id DESC LIMIT 300) ORDER BY id")
q("sc16_glyph_set", "SELECT cam, count(DISTINCT floor) AS labelled_floors, min(floor) AS first_label, max(floor) AS last_label FROM {door} WHERE floor IS NOT NULL AND reason IN ('ok', 'single_panel') GROUP BY cam")
q("sk6_review_state", "SELECT cam, counting_version, count(*) FILTER (WHERE status = 'reviewed') AS n_reviewed, CASE WHEN count(*) FILTER (WHERE status = 'reviewed') >= 20 THEN 'live' ELSE 'pending' END AS state FROM {episode} GROUP BY 1, 2")
q("sk9_export_door_cycles", "SELECT id, cam, ts_us, floor, close_travel_s, split_part(door_version, '+', 1) AS era FROM {door} WHERE door_state = 'closed' AND door_version LIKE 'bbbb2222%'")
q("sk9_export_per_floor", "SELECT cam, floor, count(*) AS reads, min(ts_us) AS first_us, max(ts_us) AS last_us FROM {door} WHERE floor IS NOT NULL GROUP BY 1, 2")
q("sk9_export_riders_per_day", "SELECT BUCKET(ts_us + 19800000000, 86400000000) AS day, cam, count(*) FILTER (WHERE direction = 'in') AS boarded, count(*) FILTER (WHERE direction IS DISTINCT FROM 'in') AS alighted FROM {transit} GROUP BY 1, 2")
q(
    "sk9_export_riders_wide",
    """SELECT BUCKET(ts_us + 19800000000, 86400000000) AS day, count(*) FILTER (WHERE cam = 'ch16') AS ch16, count(*) FILTER (WHERE cam = 'ch27') AS ch27, count(*) FILTER (WHERE cam = 'ch29') AS ch29, count(*) FILTER (WHERE cam = 'ch30') AS ch30,
      count(*) FILTER (WHERE cam = 'ch32') AS ch32, count(*) FILTER (WHERE cam = 'ch34') AS ch34, count(*) FILTER (WHERE cam = 'ch37') AS ch37 FROM {transit} GROUP BY 1""",
)
q("pf1_half_open", "SELECT count(*) AS n, count(*) FILTER (WHERE ts_us = 1704672000000000) AS at_start FROM {door} WHERE ts_us >= 1704672000000000 AND ts_us < 1704758400000000")
q("pf4_rolling_window", "SELECT cam, count(*) AS n FROM {door} WHERE ts_us >= 1706659200000000 - 7 * 86400000000 GROUP BY cam")
q(
    "pf13_two_gates",
    """SELECT cam, basis, confirmer, persons, basis AND confirmer AND persons > 0 AS printable FROM (SELECT cam, count(*) FILTER (WHERE status = 'reviewed') >= 20 AS basis, count(*) FILTER (WHERE human_boarded IS NOT NULL AND NOT occupancy_degraded) >= 5 AS confirmer, sum(machine_boarded) AS persons FROM {episode} GROUP BY cam)""",
)
q(
    "jn18_fallback_chain",
    """WITH own AS (SELECT cam, avg(read_conf) AS v FROM {door} WHERE door_version LIKE '%h3%' GROUP BY cam HAVING count(*) > 100), prior AS (SELECT cam, avg(read_conf) AS v FROM {door} WHERE door_version LIKE 'aaaa%' GROUP BY cam)
    SELECT coalesce(o.cam, p.cam) AS cam, round(coalesce(o.v, p.v, 0.5), 6) AS conf, CASE WHEN o.v IS NOT NULL THEN 'own' WHEN p.v IS NOT NULL THEN 'prior' ELSE 'default' END AS source FROM own o FULL OUTER JOIN prior p ON o.cam = p.cam""",
)
q(
    "wn12_string_segments",
    """WITH p AS (SELECT cam, floor, lag(floor) OVER (PARTITION BY cam ORDER BY ts_us, id) AS prev, k FROM {door} WHERE floor IS NOT NULL OR k >= 90)
    SELECT cam, count(*) FILTER (WHERE floor IS DISTINCT FROM prev AND (floor IS NULL OR prev IS NULL)) AS unmappable, count(*) FILTER (WHERE floor <> prev) AS changed FROM p GROUP BY cam""",
)
q(
    "wn14_dwell_filtered",
    """WITH r AS (SELECT cam, door_version, door_state, ts_us, id, lag(door_state) OVER w AS prev FROM {door} WHERE door_state IS NOT NULL WINDOW w AS (PARTITION BY cam, door_version ORDER BY ts_us, id)),
    s AS (SELECT *, lag(ts_us) OVER (PARTITION BY cam, door_version ORDER BY ts_us, id) AS began FROM r WHERE prev IS NULL OR prev <> door_state)
    SELECT cam, door_version, count(*) AS cycles, count(*) FILTER (WHERE ts_us - began >= 900000000) AS held FROM s WHERE door_state = 'closed' AND prev IN ('closing', 'open') GROUP BY 1, 2""",
)
q("sf8_normalised_range", "SELECT floor, upper(trim(replace(replace(floor || ' - ' || floor, ' - ', '-'), ',', ''))) AS range_text, count(*) AS n FROM {door} WHERE floor IS NOT NULL GROUP BY 1, 2")
q("sf9_version_text", "SELECT cam, door_version, cam || ' [' || split_part(door_version, '+', 1) || ']' AS caption, count(*) AS n FROM {door} GROUP BY 1, 2")
q(
    "sf10_age_phrase",
    """SELECT cam, CASE WHEN age < 60 THEN CAST(age AS STRING) || 's' WHEN age < 3600 THEN CAST(BUCKET(age, 60) AS STRING) || 'm' WHEN age < 86400 THEN CAST(BUCKET(age, 3600) AS STRING) || 'h' ELSE CAST(BUCKET(age, 86400) AS STRING) || 'd' END AS phrase FROM (SELECT cam, BUCKET(1706659200000000 - max(ts_us), 1000000) AS age FROM {door} GROUP BY cam)""",
)
q("sf13_linear_percentile", "SELECT cam, round(PCT(close_travel_s, 0.9) + 1e-7, 4) AS p90, round(PCT(close_travel_s, 0.1) + 1e-7, 4) AS p10 FROM {door} GROUP BY cam")
q("sf14_display_rounding", "SELECT cam, count(*) AS n, round(avg(close_travel_s) + 1e-7, 2) AS mean_2, min(close_travel_s) AS least, max(close_travel_s) AS most FROM {door} GROUP BY cam")
q(
    "sf16_point_in_polygon",
    """WITH p AS (SELECT id, DOUBLED(k) AS x, DOUBLED(id % 100) AS y FROM {door}), e AS (SELECT 10.5 AS x1, 10.5 AS y1, 90.5 AS x2, 20.5 AS y2 UNION ALL SELECT 90.5, 20.5, 60.5, 80.5 UNION ALL SELECT 60.5, 80.5, 20.5, 60.5 UNION ALL SELECT 20.5, 60.5, 10.5, 10.5)
    SELECT p.id, count(*) % 2 = 1 AS inside FROM p JOIN e ON (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY p.id""",
)
q("sf19_glyphs", "SELECT glyph, count(*) AS n FROM (SELECT UNNEST(SPLITCHARS(floor)) AS glyph FROM {door} WHERE floor IS NOT NULL) WHERE glyph <> '' GROUP BY glyph")
q(
    "sx4_verdict",
    """SELECT cam, door_version, CASE WHEN round(lo, 2) > 50 THEN 'clears above' WHEN round(hi, 2) < 50 THEN 'clears below' ELSE 'straddles' END AS verdict FROM (SELECT cam, door_version, avg(close_travel_s) - 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) AS lo,
      avg(close_travel_s) + 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) AS hi FROM {door} WHERE door_state = 'closing' GROUP BY 1, 2 HAVING count(*) > 1)""",
)
q(
    "sx5_interval_quality",
    """SELECT cam, door_version, n, n < 30 OR 2 * half > 0.5 * abs(m) AS weak, CAST(ceil(n * (half / 5.0) * (half / 5.0)) AS BIGINT) AS needed FROM (SELECT cam, door_version, count(*) AS n, avg(close_travel_s) AS m, 1.959963984540054 * stddev_samp(close_travel_s) / sqrt(count(*)) AS half
      FROM {door} WHERE door_state = 'closing' GROUP BY 1, 2 HAVING count(*) > 1)""",
)
q(
    "sx8_stratified_medians",
    """WITH r AS (SELECT cam, close_travel_s, row_number() OVER (PARTITION BY cam ORDER BY read_conf, id) - 1 AS i, count(*) OVER (PARTITION BY cam) AS n FROM {door} WHERE door_state = 'closing')
    SELECT cam, least(3, BUCKET(i, greatest(1, floor(n / 4)))) AS chunk, count(*) AS n, round(PCT(close_travel_s, 0.5) + 1e-7, 4) AS median_s FROM r GROUP BY 1, 2""",
)
q(
    "so5_ranked_findings",
    """WITH f AS (SELECT cam, CASE WHEN avg(close_travel_s) > 50 THEN 1 WHEN count(*) < 50 THEN 3 ELSE 2 END AS priority, count(*) AS n FROM {door} WHERE door_state = 'closing' GROUP BY cam)
    SELECT row_number() OVER (ORDER BY priority, n DESC, cam) AS number, cam, priority, n FROM f""",
)
q("so9_known_cameras", "SELECT DISTINCT d.cam, d.cam IN (SELECT 'ch' || CAST(channel AS STRING) FROM {channels}) AS known FROM {door} d")
q("sr6_freshest", "SELECT cam, BUCKET(ts_us, 3600000000) AS batch, MAXBY(door_state, ts_us) AS door_state, max(ts_us) AS ts_us FROM {door} GROUP BY 1, 2")
q(
    "sr8_late_attribution",
    """SELECT t.id, min(e.id) AS episode_id FROM {transit} t LEFT JOIN {episode} e ON e.cam = t.cam AND BUCKET(e.start_us, 21600000000) BETWEEN BUCKET(t.ts_us, 21600000000) - 1 AND BUCKET(t.ts_us, 21600000000) + 1 AND t.ts_us BETWEEN e.start_us - 300000000 AND e.end_us + 300000000 GROUP BY t.id""",
)
