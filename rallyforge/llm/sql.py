"""SQL that gives the same rows as the queries of this package, where SQL can."""

#: Counted rows of sources, by frame, with what the next row looks like.
_P1 = """
WITH newest AS (
  SELECT game_id, clip, player, frame, t, speed, dist_t FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, clip, player, frame ORDER BY ingested_at DESC NULLS LAST) AS rn
    FROM positions WHERE player <> '' AND frame IS NOT NULL) WHERE rn = 1),
scaled AS (
  SELECT n.game_id, n.clip, n.player, n.frame, CASE WHEN NOT isnan(t) THEN t END AS t, coalesce(g.frame_stride, 1) AS stride,
    CASE WHEN isfinite(speed) AND isfinite(dist_t) THEN CAST(round(speed * 10000) AS BIGINT) END AS v,
    CASE WHEN isfinite(speed) AND isfinite(dist_t) THEN CAST(round(dist_t * 10000) AS BIGINT) END AS d
  FROM newest n LEFT JOIN games g USING (game_id)),
linked AS (
  SELECT *, CASE WHEN abs(v - lag(v) OVER w) <= 200 AND abs(d - lag(d) OVER w) <= 200 AND frame - lag(frame) OVER w <= 3 * stride
    THEN 0 ELSE 1 END AS new FROM scaled WINDOW w AS (PARTITION BY game_id, clip, player ORDER BY frame)),
numbered AS (
  SELECT *, sum(new) OVER (PARTITION BY game_id, clip, player ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM linked),
runs AS (
  SELECT game_id, clip, player, min(frame) AS frame_first, max(frame) AS frame_last, count(*) AS n_rows,
    round(max(t) - min(t), 6) AS duration FROM numbered GROUP BY game_id, clip, player, run)
"""

#: Percentiles by rank; missing values do not count, infinite ones do.
_P5 = """
WITH newest AS (
  SELECT game_id, player, speed, dist_t FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, clip, player, frame ORDER BY ingested_at DESC NULLS LAST) AS rn
    FROM positions WHERE player <> '' AND frame IS NOT NULL) WHERE rn = 1),
wide AS (
  SELECT 'player' AS level, CAST(NULL AS VARCHAR) AS game_id, player, speed, dist_t FROM newest
  UNION ALL SELECT 'game_player', game_id, player, speed, dist_t FROM newest),
long AS (
  SELECT level, game_id, player, 'speed' AS metric, CASE WHEN NOT isnan(speed) THEN speed END AS v FROM wide
  UNION ALL SELECT level, game_id, player, 'dist_t', CASE WHEN NOT isnan(dist_t) THEN dist_t END FROM wide),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY level, game_id, player, metric ORDER BY v NULLS LAST) AS r,
    count(v) OVER (PARTITION BY level, game_id, player, metric) AS n FROM long),
wanted AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q)
SELECT level, game_id, player, metric, q, n, v AS value, CAST(0 AS BIGINT) AS rank_error
FROM ranked, wanted WHERE r = greatest(1, CAST(ceil(q * n) AS BIGINT))
"""

#: Reachability over shared detections, by a recursive set of pairs (tracklet, reached smaller tracklet).
_P3_FOUND = """
WITH RECURSIVE linked AS (
  SELECT DISTINCT game_id, det_id, tracklet FROM tracklets_tmp WHERE det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1),
ties AS (
  SELECT DISTINCT a.game_id, a.tracklet AS u, b.tracklet AS v FROM linked a JOIN linked b USING (game_id, det_id) WHERE a.tracklet <> b.tracklet),
reach AS (
  SELECT game_id, u, v FROM ties
  UNION SELECT r.game_id, r.u, t.v FROM reach r JOIN ties t ON t.game_id = r.game_id AND t.u = r.v)
SELECT game_id, min(v) AS tracklet_a, u AS tracklet_b FROM reach GROUP BY game_id, u HAVING min(v) < u
"""

ORACLE = {
    # what the checks must find: nothing wrong, on as many rows as the tables have
    "p3_checks": "SELECT count(*) AS records, CAST(0 AS BIGINT) AS parted_tracklets, TRUE AS near FROM (SELECT DISTINCT game_id, det_id FROM tracklets_tmp WHERE det_id IS NOT NULL)",
    "p5_checks": _P5.replace("SELECT level, game_id, player, metric, q, n, v AS value, CAST(0 AS BIGINT) AS rank_error", "SELECT player, metric, q, n, TRUE AS within") + " AND level = 'player'",
    "p7_checks": "SELECT DISTINCT lower(trim(source, chr(32) || chr(9) || chr(10) || chr(13))) AS source, FALSE AS over_repeated, TRUE AS in_share FROM mix_targets WHERE source IS NOT NULL",
    "p8_checks": "SELECT DISTINCT limit_name, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS unfinished FROM piece_limits",
    "p3_found": _P3_FOUND,
    "p5_percentiles": _P5,
    "p1_found": _P1 + "SELECT game_id, clip, player, frame_first, frame_last FROM runs WHERE n_rows >= 4",
    "p1_runs": _P1 + "SELECT game_id, clip, player, frame_first, frame_last, n_rows, duration FROM runs",
}
