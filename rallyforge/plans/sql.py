"""SQL that gives the same rows as the core's queries, where SQL can. Written apart from the DataFrame code: other join
and window forms wherever there is a choice."""

_FINITE = ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in ("t", "x", "y", "speed", "dist_t", "conf", "fx", "fy", "x_raw", "y_raw"))
POS = f"""newest AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY game_id, clip, player, frame ORDER BY ingested_at DESC NULLS LAST) AS rn
    FROM positions WHERE player <> '' AND frame IS NOT NULL) WHERE rn = 1),
pos AS (SELECT game_id, clip, player, frame, {_FINITE}, interpolated, ankle_vis, feet_cut FROM newest)"""
RAL = "ral AS (SELECT DISTINCT ON (game_id, clip, rally) * REPLACE (" + ", ".join(
    f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in ("rest_before", "dist_p1", "dist_p2", "tdist_p1", "tdist_p2", "tshare_p1", "tshare_p2", "maxspeed_p1", "maxspeed_p2", "closer_to_t_p1")
) + ") FROM rallies)"
_SIDES = ", ".join(f"max({c}) FILTER (WHERE player = 'p{p}') AS {n}{p}" for p in "12" for c, n in (("x", "x"), ("y", "y"), ("speed", "v"), ("dist_t", "d")))


def wide(pos: str = "pos") -> str:
    return f"""wide AS (
  SELECT game_id, clip, frame, coalesce(max(t) FILTER (WHERE player = 'p1'), max(t) FILTER (WHERE player = 'p2')) AS t, {_SIDES}
  FROM {pos} WHERE player IN ('p1', 'p2') GROUP BY game_id, clip, frame)"""


INSIDE = """inside AS (
  SELECT * FROM (
    SELECT w.*, (SELECT max(r.rally) FROM ral r WHERE r.game_id = w.game_id AND r.clip = w.clip AND w.t BETWEEN r.t_start AND r.t_end) AS rally FROM wide w)
  WHERE rally IS NOT NULL)"""
PLAYERS = """players AS (
  SELECT game_id, clip, frame, t, rally, 'p1' AS player, x1 AS x, y1 AS y, v1 AS speed, d1 AS dist_t, x2 AS ox, y2 AS oy, d2 AS od FROM inside
  UNION ALL SELECT game_id, clip, frame, t, rally, 'p2', x2, y2, v2, d2, x1, y1, d1 FROM inside)"""


def rates(pos: str = "pos") -> str:
    return f"""times AS (SELECT DISTINCT game_id, clip, t FROM {pos} WHERE t IS NOT NULL),
rates AS (
  SELECT game_id, clip, 1 / median(gap) AS fps_eff
  FROM (SELECT game_id, clip, t - lag(t) OVER (PARTITION BY game_id, clip ORDER BY t) AS gap FROM times) GROUP BY game_id, clip)"""


ACTIVE = """active AS (
  SELECT *, avg(coalesce(v1, 0) + coalesce(v2, 0)) OVER (PARTITION BY game_id, clip ORDER BY frame
    ROWS BETWEEN w // 2 PRECEDING AND (w - 1) // 2 FOLLOWING) AS activity
  FROM (SELECT wide.*, fps_eff, greatest(3, CAST(round_even(fps_eff, 0) AS BIGINT)) AS w FROM wide JOIN rates USING (game_id, clip)))"""


def pace(pos: str = "pos") -> str:
    return f"""pace AS (
  SELECT game_id, clip, fps_eff, greatest(0.8, 1.1 * a10) AS trough_lo, greatest(1.6, a25) AS lull_act, greatest(2.0, 0.85 * a50) AS act_play,
    greatest(3.0, a75) AS min_play_act, greatest(0.8, 2.5 * s10) AS slow, greatest(1.0, 3.2 * s10) AS relax_slow, greatest(0.4, 4.0 / fps_eff) AS serve_min_s
  FROM (SELECT game_id, clip, max(fps_eff) AS fps_eff, quantile_cont(activity, 0.1) AS a10, quantile_cont(activity, 0.25) AS a25,
          quantile_cont(activity, 0.5) AS a50, quantile_cont(activity, 0.75) AS a75 FROM active GROUP BY game_id, clip)
  LEFT JOIN (SELECT game_id, clip, quantile_cont(speed, 0.1) AS s10 FROM {pos} GROUP BY game_id, clip) USING (game_id, clip))"""


#: Positions made from the event stream: serve stances, play and rest follow each other, by whole numbers only.
DERIVED = """ev AS (
  SELECT 'ev' || lpad(CAST((user_id // 2) % 16 AS VARCHAR), 2, '0') AS game_id, 0 AS clip, CASE WHEN user_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS player, event_id, user_id,
    row_number() OVER (PARTITION BY (user_id // 2) % 16, user_id % 2 ORDER BY ts, event_id) - 1 AS frame FROM events),
blocks AS (
  SELECT game_id, frame // 120 AS block, CASE WHEN sum(user_id) % 2 = 0 THEN 'p1' ELSE 'p2' END AS server, CASE WHEN sum(event_id) % 3 = 0 THEN 'left' ELSE 'right' END AS box
  FROM ev GROUP BY game_id, frame // 120),
placed AS (
  SELECT e.*, frame % 120 AS phase, b.server, b.box,
    abs((17 * frame + user_id) % 1280 - 640) / 100.0::DOUBLE AS px, abs((29 * frame + user_id) % 1950 - 975) / 100.0::DOUBLE AS py
  FROM ev e JOIN blocks b ON b.game_id = e.game_id AND b.block = e.frame // 120),
seen AS (
  SELECT game_id, clip, player, frame, frame / 10.0::DOUBLE AS t, event_id % 31 = 0 AS gone,
    CASE WHEN phase >= 100 THEN 3.2 WHEN phase >= 30 THEN px WHEN player = server THEN (CASE box WHEN 'left' THEN 0.8 ELSE 5.6 END) ELSE (CASE box WHEN 'left' THEN 4.5 ELSE 1.9 END) END::DOUBLE AS x,
    CASE WHEN phase >= 100 THEN 8.0 WHEN phase >= 30 THEN py ELSE 6.2 END::DOUBLE AS y FROM placed),
spots AS (SELECT game_id, clip, player, frame, t, CASE WHEN NOT gone THEN x END AS x, CASE WHEN NOT gone THEN y END AS y FROM seen),
moves AS (
  SELECT *, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM spots WINDOW w AS (PARTITION BY game_id, clip, player ORDER BY frame)),
dpos AS (
  SELECT game_id, clip, player, frame, t, x, y, round(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)) / 0.2, 4) AS speed,
    round(sqrt((x - 3.2) * (x - 3.2) + (y - 5.44) * (y - 5.44)), 4) AS dist_t FROM moves)"""

#: The service boxes with 0.35 m around them; bounds in double precision.
_Y = f"BETWEEN {5.44 - 0.35!r}::DOUBLE AND {5.44 + 1.6 + 0.35!r}::DOUBLE"
_BOX = f"CASE WHEN {{x}} BETWEEN -0.35 AND {1.6 + 0.35!r}::DOUBLE AND {{y}} {_Y} THEN 'left' WHEN {{x}} BETWEEN {6.4 - 1.6 - 0.35!r}::DOUBLE AND {6.4 + 0.35!r}::DOUBLE AND {{y}} {_Y} THEN 'right' END"
EVENTS = f"""tests AS (
  SELECT a.*, slow, serve_min_s, {_BOX.format(x='x1', y='y1')} AS b1, {_BOX.format(x='x2', y='y2')} AS b2 FROM active a JOIN pace USING (game_id, clip)),
costs AS (
  SELECT *, CASE WHEN ((b1 = 'left' AND x2 > 3.5) OR (b1 = 'right' AND x2 < 2.9000000000000004)) AND y2 > 3.9400000000000004 AND v1 < slow AND v2 < 4 THEN v1 + 0.2 * v2 END AS c1,
    CASE WHEN ((b2 = 'left' AND x1 > 3.5) OR (b2 = 'right' AND x1 < 2.9000000000000004)) AND y1 > 3.9400000000000004 AND v2 < slow AND v1 < 4 THEN v2 + 0.2 * v1 END AS c2 FROM tests),
served AS (
  SELECT game_id, clip, frame, t, serve_min_s, CASE WHEN c2 < coalesce(c1, 1e9) THEN 'p2' WHEN c1 IS NOT NULL THEN 'p1' END AS server,
    CASE WHEN c2 < coalesce(c1, 1e9) THEN b2 WHEN c1 IS NOT NULL THEN b1 END AS box FROM costs),
stretches AS (
  SELECT *, row_number() OVER (PARTITION BY game_id, clip ORDER BY frame) - row_number() OVER (PARTITION BY game_id, clip, server ORDER BY frame) AS stretch FROM served),
events_found AS (
  SELECT game_id, clip, server, CASE WHEN count(*) FILTER (WHERE box = 'left') >= count(*) FILTER (WHERE box = 'right') THEN 'left' ELSE 'right' END AS box, min(t) AS t0, max(t) AS t1
  FROM stretches WHERE server IS NOT NULL GROUP BY game_id, clip, server, stretch HAVING max(t) - min(t) >= max(serve_min_s))"""
CLUSTERS = """sessions AS (
  SELECT *, sum(new) OVER (PARTITION BY game_id, clip ORDER BY t0, t1, server ROWS UNBOUNDED PRECEDING) AS cluster FROM (
    SELECT *, CASE WHEN t0 - lag(t1) OVER (PARTITION BY game_id, clip ORDER BY t0, t1, server) < 3.0 THEN 0 ELSE 1 END AS new FROM events_found)),
weighed AS (SELECT game_id, clip, cluster, server, box, round(sum(t1 - t0 + 0.2), 6) AS w, min(t0) AS a FROM sessions GROUP BY ALL),
spans AS (SELECT game_id, clip, cluster, min(t0) AS t0, arg_max(t1, t0) AS t1 FROM sessions GROUP BY ALL),
named AS (
  SELECT *, row_number() OVER o AS r, lead(w) OVER o AS second FROM weighed WINDOW o AS (PARTITION BY game_id, clip, cluster ORDER BY w DESC, a)),
clusters AS (
  SELECT s.game_id, s.clip, s.t0, s.t1, n.server, n.box, coalesce(n.w < round(1.5 * n.second, 6), FALSE) AS ambiguous
  FROM spans s JOIN named n ON n.game_id = s.game_id AND n.clip = s.clip AND n.cluster = s.cluster AND n.r = 1)"""

#: Through the lens and back: by the model itself, and by solving it for the distance from the centre.
_UNBENT = """unbent AS (SELECT *, 310 + (fx - 310) / s AS ux, 236 + (fy - 236) / s AS uy
  FROM (SELECT *, 1 - 0.18 * (((fx - 310) ** 2 + (fy - 236) ** 2) / 156025.0) AS s FROM pos))"""
_BENT = """bent AS (SELECT *, 310 + ({ux} - 310) * f AS bent_x, 236 + ({uy} - 236) * f AS bent_y
  FROM (SELECT *, CASE WHEN u > 0 THEN (sqrt(1 + 0.72 * u * u) - 1) / (0.36 * u * u) ELSE 1 END AS f FROM (SELECT *, sqrt(({ux} - 310) ** 2 + ({uy} - 236) ** 2) / 395.0 AS u FROM {source})))"""
_ZROW = "CASE WHEN y < 3.0 THEN 0 WHEN y < 6.24 THEN 1 WHEN y IS NOT NULL THEN 2 END"
_DIST = "sqrt((x - 3.2) * (x - 3.2) + (y - 5.44) * (y - 5.44))"
_ISLAND = "row_number() OVER (PARTITION BY game_id, clip, player ORDER BY frame) - row_number() OVER (PARTITION BY game_id, clip, player, {s} ORDER BY frame)"


def q(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def shares(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"round({e}, 5) AS {n}" for e, n in pairs)


_SERVE = (POS, wide(), rates(), ACTIVE, pace(), EVENTS)
#: The same chain over the positions made from events, for tests.
SERVE_OF_EVENTS = (DERIVED, wide("dpos"), rates("dpos"), ACTIVE, pace("dpos"), EVENTS)

ORACLE: dict[str, str] = {
    "p4_found": q(POS, """filled AS (
  SELECT DISTINCT game_id, clip, player, CAST(floor(t * 2) AS BIGINT) AS k FROM newest
  WHERE isfinite(t) AND NOT isnan(x) AND NOT isnan(y) AND NOT coalesce(interpolated, FALSE)),
gaps AS (SELECT *, lead(k) OVER (PARTITION BY game_id, clip, player ORDER BY k) AS next_k FROM filled)""",
        select="SELECT game_id, clip, player, unnest(generate_series(k + 1, next_k - 1)) AS period_no FROM gaps WHERE next_k > k + 1"),
    "court_zone_share": q(POS, f"z AS (SELECT game_id, player, ['front', 'mid', 'back'][{_ZROW} + 1] || CASE WHEN x >= 3.2 THEN '-right' ELSE '-left' END AS zone FROM pos WHERE x IS NOT NULL AND y IS NOT NULL)",
        select="SELECT game_id, player, zone, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY game_id, player), 6) AS share FROM z GROUP BY game_id, player, zone"),
    "court_points": q(POS, select=f"""SELECT game_id, clip, player, frame, {_ZROW} AS zone_row, CAST(x >= 3.2 AS INT) AS zone_col, round({_DIST}, 4) AS dist,
  x BETWEEN 0 AND 1.6 AND y BETWEEN 5.44 AND 7.04 AS in_left, {_BOX.format(x='x', y='y')} AS box, x > 3.5 AND y > 3.9400000000000004 AS waits_for_left,
  x < 4.5 AND y > 3.9400000000000004 AS past_line_right, round(least(greatest(x, 0.0), 6.4), 4) AS x_clipped FROM pos WHERE x IS NOT NULL AND y IS NOT NULL"""),
    "foot_point_projection": q(POS, """det AS (SELECT *, coalesce(conf > 0.5, FALSE) AS l, coalesce(1 - conf > 0.5, FALSE) AS r FROM pos WHERE fx IS NOT NULL AND fy IS NOT NULL),
ank AS (SELECT *, CASE WHEN l AND r THEN fx + 0.5 WHEN l THEN fx - 5 WHEN r THEN fx + 6 ELSE fx + 1 END AS ax, CASE WHEN l AND r THEN fy - 8.5 WHEN l THEN fy - 8 WHEN r THEN fy - 9 ELSE fy END AS ay FROM det)""",
        select="""SELECT game_id, clip, player, frame, round(ax, 4) AS fx, round(CASE WHEN fy >= 427 THEN ay + (ay - 385) * 0.08 / 0.52 ELSE fy END, 4) AS fy,
  l OR r AS ankle_vis, fy >= 427 AS feet_cut FROM ank"""),
    "lens_undistort": q(POS, _UNBENT, select="SELECT game_id, clip, player, frame, round(ux, 4) AS ux, round(uy, 4) AS uy FROM unbent"),
    "lens_round_trip": q(POS, _UNBENT, "near AS (SELECT * FROM unbent WHERE sqrt((fx - 310) ** 2 + (fy - 236) ** 2) < 300)", _BENT.format(source="near", ux="ux", uy="uy"),
        select="""SELECT player, count(*) AS n, round(avg(sqrt((ux - fx) ** 2 + (uy - fy) ** 2)), 5) AS mean_shift, round(max(sqrt((bent_x - fx) ** 2 + (bent_y - fy) ** 2)), 6) AS largest_error
  FROM bent GROUP BY player"""),
    "homography_project": q(POS, _UNBENT,
        select="SELECT game_id, clip, player, frame, round((0.018 * ux - 1.5) / (0.0012 * uy + 1), 4) AS cx, round((0.027 * uy - 4.2) / (0.0012 * uy + 1), 4) AS cy FROM unbent"),
    "court_to_pixels": q(POS, "v AS (SELECT *, (y + 4.2) / (0.027 - 0.0012 * y) AS fy0 FROM pos), w AS (SELECT *, (x * (0.0012 * fy0 + 1) + 1.5) / 0.018 AS fx0 FROM v)", _BENT.format(source="w", ux="fx0", uy="fy0"),
        select="SELECT game_id, clip, player, frame, round(bent_x, 4) AS px, CASE WHEN x IS NOT NULL THEN round(bent_y, 4) END AS py FROM bent"),
    "court_lines": """SELECT name, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1 FROM (VALUES ('front wall', 0.0, 0.0, 6.4, 0.0), ('back wall', 0.0, 9.75, 6.4, 9.75), ('left wall', 0.0, 0.0, 0.0, 9.75), ('right wall', 6.4, 0.0, 6.4, 9.75),
  ('short line', 0.0, 5.44, 6.4, 5.44), ('half line', 3.2, 5.44, 3.2, 9.75), ('left box', 0.0, 5.44, 1.6, 5.44), ('left box', 0.0, 7.04, 1.6, 7.04), ('left box', 0.0, 5.44, 0.0, 7.04),
  ('left box', 1.6, 5.44, 1.6, 7.04), ('right box', 4.8, 5.44, 6.4, 5.44), ('right box', 4.8, 7.04, 6.4, 7.04), ('right box', 4.8, 5.44, 4.8, 7.04), ('right box', 6.4, 5.44, 6.4, 7.04)) v(name, x0, y0, x1, y1)""",
    "sample_rate": q(POS, rates(), select="SELECT game_id, clip, round(fps_eff, 4) AS fps_eff FROM rates"),
    "activity_signal": q(POS, wide(), rates(), ACTIVE, select="SELECT game_id, clip, frame, t, round(activity, 8) AS activity FROM active"),
    "pace_percentiles": q(POS, wide(), rates(), ACTIVE, pace(), select="SELECT game_id, clip, " + ", ".join(
        f"round({c}, 5) AS {c}" for c in ("fps_eff", "trough_lo", "lull_act", "act_play", "min_play_act", "slow", "relax_slow", "serve_min_s")) + " FROM pace"),
    "both_players_still": q(POS, wide(), select="SELECT game_id, clip, frame, " + " AND ".join(
        f"coalesce(CASE WHEN count({v}) OVER w >= 2 THEN avg({v}) OVER w END, 9.0) < 0.6" for v in ("v1", "v2"))
        + " AS still FROM wide WINDOW w AS (PARTITION BY game_id, clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"),
    "gradient_speed": q(POS, "n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY game_id, clip, player) AS k FROM pos WINDOW w AS (PARTITION BY game_id, clip, player ORDER BY frame))",
        """g AS (SELECT a.game_id, a.clip, a.player, a.frame, CASE WHEN a.k > 1 THEN
    sqrt(((c.x - b.x) / (c.t - b.t)) ** 2 + ((c.y - b.y) / (c.t - b.t)) ** 2) END AS v
  FROM n a LEFT JOIN n b ON b.game_id = a.game_id AND b.clip = a.clip AND b.player = a.player AND b.i = greatest(a.i - 1, 1)
  LEFT JOIN n c ON c.game_id = a.game_id AND c.clip = a.clip AND c.player = a.player AND c.i = least(a.i + 1, a.k))""",
        select="SELECT game_id, clip, player, frame, CASE WHEN v <= 8 THEN round(v, 4) END AS v FROM g"),
    "trail_window": q(POS, "ms AS (SELECT *, CAST(round(t * 1000) AS BIGINT) AS ms FROM pos WHERE t IS NOT NULL)",
        select="""SELECT game_id, clip, player, frame, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER w AS points,
  round(coalesce(sum(x) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) OVER w, 0), 4) AS sum_x FROM ms
  WINDOW w AS (PARTITION BY game_id, clip, player ORDER BY ms RANGE BETWEEN 2000 PRECEDING AND CURRENT ROW)"""),
    "serve_events": q(*_SERVE, select="SELECT game_id, clip, server, box, t0, t1 FROM events_found"),
    "serve_clusters": q(*_SERVE, CLUSTERS, select="SELECT game_id, clip, t0, t1, server, box FROM clusters"),
    "ambiguous_clusters": q(*_SERVE, CLUSTERS, select="SELECT game_id, count(*) AS clusters, CAST(sum(CAST(ambiguous AS INT)) AS BIGINT) AS ambiguous FROM clusters GROUP BY game_id"),
    "score_progress": q(RAL, """n AS (SELECT *, lead(server) OVER w AS ns, lead(box) OVER w AS nb, lead(rally) OVER w IS NULL AS is_last FROM ral WINDOW w AS (PARTITION BY game_id, clip ORDER BY rally)),
k AS (SELECT *, CASE WHEN server IS NULL OR is_last OR ns IS NULL OR (ns = server AND nb IS NOT DISTINCT FROM box) THEN NULL ELSE ns END AS w0 FROM n),
b AS (SELECT *, coalesce(count(*) FILTER (WHERE w0 = 'p1') OVER u, 0) AS a1, coalesce(count(*) FILTER (WHERE w0 = 'p2') OVER u, 0) AS a2 FROM k
  WINDOW u AS (PARTITION BY game_id, clip ORDER BY rally ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT * EXCLUDE (winner), CASE WHEN is_last AND server IS NOT NULL THEN (CASE WHEN a1 = 14 AND a2 < 14 THEN 'p1' WHEN a2 = 14 AND a1 < 14 THEN 'p2' END) ELSE w0 END AS winner FROM b)""",
        select="""SELECT game_id, clip, rally, winner, a1 + CAST(coalesce(winner = 'p1', FALSE) AS BIGINT) AS score_p1, a2 + CAST(coalesce(winner = 'p2', FALSE) AS BIGINT) AS score_p2,
  CASE WHEN server IS NULL THEN 'no serve seen' WHEN winner IS NOT NULL THEN '' WHEN is_last THEN 'last rally: winner unknown'
    WHEN ns = server AND nb IS NOT DISTINCT FROM box THEN 'let (same server, same box)' ELSE 'next serve not seen: winner unknown' END AS note FROM e"""),
    "rest_before": q(RAL, select="SELECT game_id, clip, rally, round(t_start - lag(t_end) OVER (PARTITION BY game_id, clip ORDER BY rally), 3) AS rest FROM ral"),
    "rally_interval_join": q(POS, RAL, wide(), INSIDE, select="SELECT game_id, clip, rally, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame FROM inside GROUP BY ALL"),
    "rally_path_length": q(POS, RAL, wide(), "hits AS (SELECT w.*, r.rally FROM wide w JOIN ral r ON r.game_id = w.game_id AND r.clip = w.clip AND w.t BETWEEN r.t_start AND r.t_end)",
        "s AS (SELECT *, " + ", ".join(f"sqrt((x{p} - lag(x{p}) OVER w) ** 2 + (y{p} - lag(y{p}) OVER w) ** 2) AS s{p}" for p in "12") + " FROM hits WINDOW w AS (PARTITION BY game_id, clip, rally ORDER BY frame))",
        select="SELECT game_id, clip, rally, " + ", ".join(
            f"round(coalesce(sum(s{p}), 0), 5) AS dist_p{p}, round(avg(d{p}), 5) AS tdist_p{p}, round(CASE WHEN count(d{p}) > 0 THEN count(*) FILTER (WHERE d{p} < 1.5) / count(*) END, 5) AS tshare_p{p}, round(max(v{p}), 5) AS maxspeed_p{p}" for p in "12")
        + ", round(avg(CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL THEN CAST(d1 < d2 AS INT) END), 5) AS closer_to_t_p1 FROM s GROUP BY game_id, clip, rally"),
    "player_movement": q(POS, RAL, wide(), INSIDE, PLAYERS, f"""m AS (SELECT *, {_ZROW} AS zr, CAST(x >= 3.2 AS INT) AS zc,
  coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS step, x IS NOT NULL AND od IS NOT NULL AS both_seen FROM players WINDOW w AS (PARTITION BY game_id, clip, player ORDER BY frame))""",
        select="SELECT game_id, clip, player, count(x) AS frames_in_rally, " + shares(
            ("count(x) / count(*)", "tracked_share"), ("count(*) FILTER (WHERE dist_t < 1) / count(*)", "t_share_1m"), ("count(*) FILTER (WHERE dist_t < 1.5) / count(*)", "t_share_1_5m"),
            ("avg(CASE WHEN both_seen THEN CAST(coalesce(dist_t < od, FALSE) AS INT) END)", "closer_to_t_share"), ("avg(dist_t)", "mean_dist_t"), ("median(dist_t)", "median_dist_t"),
            ("avg(CAST(zr = 0 AS INT))", "front_share"), ("avg(CAST(zr = 1 AS INT))", "mid_share"), ("avg(CAST(zr = 2 AS INT))", "back_share"), ("avg(1 - zc)", "left_share"), ("avg(zc)", "right_share"),
            ("avg(zc)", "forehand_side_share"), ("avg(1 - zc)", "backhand_side_share"), ("avg(CASE WHEN both_seen AND od < 1 THEN CAST(y > 6.24 AS INT) END)", "back_when_opponent_at_t"),
            ("sum(step)", "distance_rally_m"), ("avg(speed)", "mean_speed"), ("quantile_cont(speed, 0.99)", "peak_speed")) + " FROM m GROUP BY game_id, clip, player"),
    "heatmap_bins": q(POS, RAL, wide(), INSIDE, PLAYERS, select="""SELECT game_id, player, CAST(least(floor(y / 0.25), 38) AS BIGINT) AS yb, CAST(least(floor(x / 0.25), 25) AS BIGINT) AS xb, count(*) AS n
  FROM players WHERE x BETWEEN 0 AND 6.5 AND y BETWEEN 0 AND 9.75 GROUP BY ALL"""),
    "speed_histogram": q(POS, RAL, wide(), INSIDE, PLAYERS, "b AS (SELECT player, CAST(least(floor(speed / 0.25), 24) AS BIGINT) AS bin, count(*) AS n FROM players WHERE speed BETWEEN 0 AND 6.25 GROUP BY ALL)",
        select="SELECT player, bin, n, round(n / (sum(n) OVER (PARTITION BY player) * 0.25), 8) AS density FROM b"),
    "excursion_recovery": q(POS, RAL, wide(), INSIDE, PLAYERS, f"""o AS (SELECT *, coalesce(dist_t > 1.5, FALSE) AS away FROM players WHERE t IS NOT NULL),
i AS (SELECT *, {_ISLAND.format(s='away')} AS k, lead(t) OVER (PARTITION BY game_id, clip, player ORDER BY frame) AS next_t FROM o),
r AS (SELECT game_id, clip, player, away, k, arg_max(next_t, frame) FILTER (WHERE next_t IS NOT NULL) AS b0, max(frame) AS lf, arg_min(t, frame) AS a FROM i GROUP BY ALL),
f AS (SELECT r.game_id, r.clip, r.player, i.next_t - r.a AS took FROM r JOIN i ON i.game_id = r.game_id AND i.clip = r.clip AND i.player = r.player AND i.frame = r.lf WHERE r.away)""",
        select="""SELECT p.game_id, p.clip, p.player, coalesce(n, 0) AS n_excursions, recovery_s FROM (SELECT DISTINCT game_id, clip, player FROM o) p LEFT JOIN (
  SELECT game_id, clip, player, count(*) FILTER (WHERE took < 15) AS n, round(median(took) FILTER (WHERE took < 15), 4) AS recovery_s FROM f GROUP BY ALL) USING (game_id, clip, player)"""),
    "speed_bursts": q(POS, RAL, wide(), INSIDE, PLAYERS, f"""o AS (SELECT *, coalesce(speed, 0) > 3 AS fast FROM players WHERE t IS NOT NULL), i AS (SELECT *, {_ISLAND.format(s='fast')} AS k FROM o),
r AS (SELECT game_id, clip, player, max(t) - min(t) AS s FROM i WHERE fast GROUP BY game_id, clip, player, k)""",
        select="""SELECT p.game_id, p.clip, p.player, count(s) FILTER (WHERE s >= 0.499999) AS bursts FROM (SELECT DISTINCT game_id, clip, player FROM o) p LEFT JOIN r USING (game_id, clip, player) GROUP BY ALL"""),
    "longest_streak": q(RAL, "n AS (SELECT *, row_number() OVER (PARTITION BY game_id, clip ORDER BY rally) - row_number() OVER (PARTITION BY game_id, clip, winner ORDER BY rally) AS k FROM ral)",
        select="SELECT game_id, clip, player, max(n) AS longest_run FROM (SELECT game_id, clip, winner AS player, count(*) AS n FROM n WHERE winner IS NOT NULL GROUP BY game_id, clip, winner, k) GROUP BY ALL"),
    "player_points": q(RAL, "r AS (SELECT *, 'p1' AS player, dist_p1 AS way FROM ral UNION ALL SELECT *, 'p2', dist_p2 FROM ral)",
        select="""SELECT game_id, clip, player, count(*) FILTER (WHERE winner = player) AS points_won, count(*) FILTER (WHERE winner <> player) AS points_lost,
  count(*) FILTER (WHERE server = player) AS rallies_served, count(*) FILTER (WHERE server = player AND winner = player) AS points_won_on_serve,
  count(*) FILTER (WHERE server <> player) AS rallies_received, count(*) FILTER (WHERE server <> player AND winner = player) AS points_won_on_receive,
  round(avg(duration) FILTER (WHERE winner = player), 5) AS mean_rally_won_s, round(avg(duration) FILTER (WHERE winner <> player), 5) AS mean_rally_lost_s, round(avg(way), 5) AS distance_per_rally_m,
  round(avg(way) FILTER (WHERE winner = player), 5) AS distance_won_m, round(avg(way) FILTER (WHERE winner <> player), 5) AS distance_lost_m FROM r GROUP BY game_id, clip, player"""),
    "serve_by_box": q(RAL, select="SELECT game_id, clip, server, box, count(*) AS served, count(*) FILTER (WHERE winner = server) AS won FROM ral WHERE server IS NOT NULL AND box IS NOT NULL GROUP BY ALL"),
    "game_summary": q(RAL, "n AS (SELECT *, lead(server) OVER w AS ns, lead(box) OVER w AS nb FROM ral WINDOW w AS (PARTITION BY game_id, clip ORDER BY rally))",
        select="""SELECT game_id, clip, min(t_start) AS t_first, max(t_end) AS t_last, count(*) AS n_rallies, count(winner) AS n_points,
  count(*) FILTER (WHERE note LIKE '%let (same%') AS n_lets, count(*) FILTER (WHERE winner IS NULL AND NOT coalesce(note LIKE '%let (same%', FALSE)) AS n_unknown,
  round(avg(duration), 5) AS mean_rally_s, round(median(duration), 5) AS median_rally_s, max(duration) AS longest_rally_s, first(rally ORDER BY duration DESC, rally) AS longest_rally_no,
  round(sum(duration), 5) AS total_rally_s, round(coalesce(sum(rest_before), 0), 5) AS total_rest_s, round(avg(rest_before), 5) AS mean_rest_s,
  round(CASE WHEN sum(rest_before) > 0 THEN sum(duration) / sum(rest_before) END, 5) AS work_rest_ratio, arg_max(score_p1, rally) AS final_p1, arg_max(score_p2, rally) AS final_p2,
  count(*) FILTER (WHERE ns = server AND winner = server AND nb <> box) AS alternations_ok, count(*) FILTER (WHERE ns = server AND winner = server) AS alternations FROM n GROUP BY game_id, clip"""),
    "separation_crowding": q(POS, RAL, wide(), INSIDE, "a AS (SELECT *, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS apart FROM inside)",
        select="SELECT game_id, clip, round(avg(apart), 5) AS mean_separation_m, round(count(*) FILTER (WHERE apart < 1) / count(*), 5) AS crowding_share FROM a GROUP BY ALL"),
    "track_reliability": q(POS, RAL, wide(), INSIDE, rates(), "f AS (SELECT game_id, clip, frame, unnest(['p1', 'p2']) AS player FROM inside)",
        select="""SELECT f.game_id, f.clip, f.player, count(*) AS n, round(count(*) FILTER (WHERE feet_cut) / count(*), 6) AS feet_cut_share,
  round(count(*) FILTER (WHERE interpolated) / count(*), 6) AS interpolated_share, round(count(x) / count(*), 6) AS tracked_share, CAST(round_even(any_value(fps_eff), 0) AS BIGINT) AS samples_per_s
  FROM f LEFT JOIN pos USING (game_id, clip, frame, player) LEFT JOIN rates USING (game_id, clip) GROUP BY ALL"""),
    "frame_rate": q(POS, "r AS (SELECT p.*, coalesce(s.stride, 1) AS stride FROM pos p LEFT JOIN (SELECT game_id, max(frame_stride) AS stride FROM games GROUP BY game_id) s USING (game_id))",
        select="SELECT game_id, clip, round(median(frame / t) / max(stride), 6) AS fps_eff FROM r WHERE frame > 0 AND t <> 0 GROUP BY game_id, clip"),
    "rally_table": q(RAL, select="""SELECT game_id, clip, rally, CAST(floor(t_start) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(t_start) % 60 AS BIGINT) AS VARCHAR), 2, '0') AS start,
  coalesce(printf('%.3f s', duration), '–') AS length, coalesce(printf('%.1f %%', tshare_p1 * 100), '–') AS t_p1,
  concat_ws(' ', upper(server[1]) || server[2:], box) AS serve, coalesce(nullif(note, ''), '–') AS note FROM ral"""),
    "gap_interpolation": q(POS, """g AS (SELECT *, lead(frame) OVER (PARTITION BY game_id, clip, player ORDER BY frame) - frame AS gap FROM pos),
c AS (SELECT game_id, clip, player, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL),
s AS (SELECT game_id, clip, player, first(gap ORDER BY n DESC, gap) AS step FROM c GROUP BY ALL),
e AS (SELECT p.game_id, p.clip, p.player, min(frame) AS a, max(frame) AS b, max(coalesce(step, 1)) AS step FROM pos p LEFT JOIN s USING (game_id, clip, player) GROUP BY ALL),
grid AS (SELECT game_id, clip, player, unnest(generate_series(a, b, step)) AS frame FROM e),
r AS (SELECT grid.*, x, y, row_number() OVER (PARTITION BY grid.game_id, grid.clip, grid.player ORDER BY grid.frame) AS n FROM grid LEFT JOIN pos USING (game_id, clip, player, frame)),
""" + ",\n".join(f"""{c}0 AS (SELECT *, max(CASE WHEN {c} IS NOT NULL THEN n END) OVER (PARTITION BY game_id, clip, player ORDER BY n ROWS UNBOUNDED PRECEDING) AS {c}p,
  min(CASE WHEN {c} IS NOT NULL THEN n END) OVER (PARTITION BY game_id, clip, player ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}n FROM r),
{c}1 AS (SELECT a.game_id, a.clip, a.player, a.n, CASE WHEN a.{c} IS NOT NULL THEN a.{c} WHEN a.n - {c}p <= 6 THEN b.{c} + (d.{c} - b.{c}) * (a.n - {c}p) / ({c}n - {c}p) END AS {c}f
  FROM {c}0 a LEFT JOIN r b ON b.game_id = a.game_id AND b.clip = a.clip AND b.player = a.player AND b.n = a.{c}p LEFT JOIN r d ON d.game_id = a.game_id AND d.clip = a.clip AND d.player = a.player AND d.n = a.{c}n)""" for c in "xy"),
        select="SELECT r.game_id, r.clip, r.player, frame, r.x IS NULL AS interpolated, round(xf, 10) AS x, round(yf, 10) AS y FROM r JOIN x1 USING (game_id, clip, player, n) JOIN y1 USING (game_id, clip, player, n)"),
    "score_asof": q(POS, RAL, wide(), select="""SELECT w.game_id, w.clip, w.frame, w.t, coalesce(r.score_p1, 0) AS score_p1, coalesce(r.score_p2, 0) AS score_p2
  FROM wide w ASOF LEFT JOIN ral r ON w.game_id = r.game_id AND w.clip = r.clip AND w.t >= r.t_end WHERE w.t IS NOT NULL"""),
    "rally_asof": q(POS, RAL, wide(), select="""SELECT game_id, clip, frame, (SELECT min(r.rally) FROM ral r WHERE r.game_id = w.game_id AND r.clip = w.clip AND w.t BETWEEN r.t_start AND r.t_end) AS rally FROM wide w WHERE t IS NOT NULL"""),
    "frames_near_rallies": q(POS, RAL, wide(), select="""SELECT game_id, clip, count(*) AS frames FROM wide w
  WHERE EXISTS (SELECT 1 FROM ral r WHERE r.game_id = w.game_id AND r.clip = w.clip AND w.t >= r.t_start - 1.0 AND w.t <= r.t_end + 1.0) GROUP BY game_id, clip"""),
    "review_topk": q(RAL, """u AS (SELECT game_id, min(user_player) AS who FROM games GROUP BY game_id),
r AS (SELECT ral.*, CASE WHEN who IN ('p1', 'p2') THEN who END AS who FROM ral LEFT JOIN u USING (game_id)),
s AS (SELECT *, 'p1' AS me, 'p2' AS them, dist_p1 AS my_way, tshare_p1 AS my_share, dist_p2 AS their_way FROM r WHERE coalesce(who, 'p1') = 'p1'
  UNION ALL SELECT *, 'p2', 'p1', dist_p2, tshare_p2, dist_p1 FROM r WHERE coalesce(who, 'p2') = 'p2'),
l AS (
  SELECT game_id, clip, rally, 0 AS seq, 'longest rally' AS reason, CAST(NULL AS VARCHAR) AS player FROM r WHERE duration IS NOT NULL QUALIFY row_number() OVER (PARTITION BY game_id, clip ORDER BY duration DESC, rally) = 1
  UNION ALL SELECT game_id, clip, rally, CASE me WHEN 'p1' THEN 1 ELSE 11 END, 'lost after much running', me FROM s WHERE winner <> me
    QUALIFY row_number() OVER (PARTITION BY game_id, clip, me ORDER BY my_way DESC NULLS LAST, rally) <= 2
  UNION ALL SELECT game_id, clip, rally, CASE me WHEN 'p1' THEN 2 ELSE 12 END, 'won while holding the T', me FROM s WHERE winner = me
    QUALIFY row_number() OVER (PARTITION BY game_id, clip, me ORDER BY my_share DESC NULLS LAST, rally) <= CASE WHEN who IS NULL THEN 1 ELSE 2 END
  UNION ALL SELECT game_id, clip, rally, CASE me WHEN 'p1' THEN 3 ELSE 13 END, 'opponent made to run', me FROM s WHERE winner = me AND who IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY game_id, clip, me ORDER BY their_way DESC NULLS LAST, rally) <= 1
  UNION ALL SELECT game_id, clip, rally, 99, 'let', NULL FROM r WHERE note LIKE '%let%')""",
        select="SELECT game_id, clip, rally, min(seq) AS seq, arg_min(reason, seq) AS reason, first(player ORDER BY seq) AS player FROM l GROUP BY ALL"),
    "class_membership": """WITH l AS (SELECT DISTINCT game_id, det_id, tracklet FROM tracklets_tmp WHERE det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1),
c AS (SELECT game_id, tracklet, CASE WHEN bool_or(n = 'p1') THEN 1 WHEN bool_or(n = 'p2') THEN 0 WHEN bool_or(n = 'other') THEN 2 ELSE -1 END AS class
  FROM (SELECT *, lower(trim(label)) AS n FROM tracklet_labels) GROUP BY ALL)
SELECT game_id, coalesce(class, -1) AS class, count(DISTINCT tracklet) AS tracklets, count(*) AS links FROM l LEFT JOIN c USING (game_id, tracklet) GROUP BY game_id, coalesce(class, -1)""",
    "fold_sizes": """WITH RECURSIVE l AS (SELECT DISTINCT game_id, det_id, tracklet FROM tracklets_tmp WHERE det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1),
g AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS i FROM (SELECT count(*) AS n FROM l GROUP BY game_id, tracklet)),
d AS (SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS k
  UNION ALL SELECT g.i, list_transform(load, lambda v, j: v + CASE WHEN j = list_position(load, list_min(load)) THEN g.n ELSE 0 END),
    list_transform(k, lambda v, j: v + CASE WHEN j = list_position(load, list_min(load)) THEN 1 ELSE 0 END) FROM d JOIN g ON g.i = d.i + 1)
SELECT CAST(f AS INT) AS fold, load[f + 1] AS links, k[f + 1] AS tracklets FROM (SELECT * FROM d ORDER BY i DESC LIMIT 1), (SELECT unnest([0, 1, 2, 3, 4]) AS f)""",
}

_SCORED = """det AS (
  SELECT game_id, clip, frame, conf, CAST(CASE player WHEN 'p1' THEN 1 ELSE 2 END AS BIGINT) AS det_id, CASE player WHEN 'p1' THEN 0 ELSE 1000000 END + frame // 40 AS tracklet, (x - 3.2) / 3.0 AS score
  FROM pos WHERE x IS NOT NULL AND y IS NOT NULL)"""
_LABELS = """lab AS (
  SELECT game_id, clip, tracklet, min(frame) AS f0, max(frame) AS f1, count(*) AS n, avg(score) AS s, avg(conf) AS conf, CASE WHEN avg(score) > 0 THEN 'p1' ELSE 'p2' END AS label,
    abs(coalesce(avg(score), 0)) * sqrt(count(*)) AS weight, coalesce(abs(avg(score)) < 0.25, FALSE) AS ambiguous FROM det GROUP BY game_id, clip, tracklet)"""
ORACLE |= {
    "tracklet_labels": q(POS, _SCORED, _LABELS, select="SELECT * REPLACE (round(s, 9) AS s, round(conf, 9) AS conf, round(weight, 9) AS weight) FROM lab"),
    "tracklet_stats": q(POS, _SCORED, _LABELS, select="""SELECT game_id, clip, count(*) AS n_tracklets, round(sum(abs(s) * n) / sum(n), 8) AS weighted_abs_score,
  CAST(coalesce(sum(n) FILTER (WHERE ambiguous), 0) AS BIGINT) AS ambiguous_rows FROM lab GROUP BY ALL"""),
    "conflict_resolver": q(POS, _SCORED, _LABELS, """d AS (SELECT det.*, label, round(weight, 8) AS weight FROM det JOIN lab USING (game_id, clip, tracklet)),
pair AS (SELECT a.*, b.det_id AS other_id, b.label AS other_label, b.weight AS other_weight FROM d a LEFT JOIN d b ON b.game_id = a.game_id AND b.clip = a.clip AND b.frame = a.frame AND b.det_id <> a.det_id)""",
        select="""SELECT game_id, clip, frame, det_id, label, CASE WHEN other_label IS NULL OR other_label <> label OR weight > other_weight OR (weight = other_weight AND det_id < other_id) THEN label
  WHEN label = 'p2' AND score > -0.8 THEN 'p1' WHEN label = 'p1' AND score < 0.8 THEN 'p2' END AS player FROM pair"""),
    "frame_pairs": """WITH e AS (SELECT vec_id // 2 AS grp, vec_id, embedding::DOUBLE[] AS v, count(*) OVER (PARTITION BY vec_id // 2) AS n FROM embeddings)
SELECT a.grp, a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.v, b.v), 4) AS dot FROM e a JOIN e b ON a.grp = b.grp AND a.vec_id < b.vec_id WHERE a.n = 2""",
    "unit_vectors": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT vec_id, round(list_inner_product(v, v) / (n * n), 6) AS norm2, round(v[1] / n, 5) AS first FROM e""",
    "feature_z_scores": q(RAL, "f AS (SELECT game_id, clip, rally, duration, dist_p1, coalesce(rest_before, (SELECT median(rest_before) FROM ral)) AS rest_before FROM ral)",
        select="SELECT game_id, clip, rally, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / (stddev_samp({c}) OVER () + 1e-9), 6) AS {c}" for c in ("duration", "dist_p1", "rest_before")) + " FROM f"),
}
_PIXELS = "pix AS (SELECT CAST(floor(fy / 40) AS BIGINT) AS py, CAST(floor(fx / 40) AS BIGINT) AS px, frame % 3 AS channel, conf AS v FROM pos WHERE fx IS NOT NULL AND fy IS NOT NULL AND conf IS NOT NULL)"
#: Winding of a point around the region's corners: inside when it lies on one side of all edges (the region is convex).
_SIDES_OF = " AND ".join(f"({x1} - {x0}) * (y - {y0}) - ({y1} - {y0}) * (x - {x0}) > 0" for (x0, y0), (x1, y1) in zip(
    [(0.5, 1.0), (6.0, 2.0), (5.0, 9.0), (1.0, 8.0)], [(6.0, 2.0), (5.0, 9.0), (1.0, 8.0), (0.5, 1.0)]))
ORACLE |= {
    "background_median": q(POS, _PIXELS, select="SELECT py, px, channel, round(median(v), 6) AS v FROM pix GROUP BY ALL"),
    "traced_line": q(POS, _PIXELS, "c AS (SELECT py, px, count(*) AS v FROM pix GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY py ORDER BY v DESC, px) AS k, min(px) OVER (PARTITION BY py) AS a, max(px) OVER (PARTITION BY py) AS b FROM c)",
        select="SELECT py, px FROM r WHERE k = 1 AND v >= 20 AND px > a AND px < b"),
    "region_filter": q(POS, select=f"SELECT game_id, clip, player, count(*) AS n FROM pos WHERE {_SIDES_OF} GROUP BY ALL"),
    "sampled_frames": q(POS, """own AS (SELECT DISTINCT ON (game_id) game_id, fps, coalesce(frame_stride, 1) AS step, coalesce(CAST(trunc(CASE WHEN NOT isnan(t_start) THEN t_start END * fps) AS BIGINT), 0) AS f0,
  CAST(trunc(CASE WHEN NOT isnan(t_end) THEN t_end END * fps) AS BIGINT) AS f1 FROM games WHERE game_id IS NOT NULL)""",
        select="SELECT game_id, clip, player, frame, frame / fps AS t FROM pos LEFT JOIN own USING (game_id) WHERE frame >= coalesce(f0, 0) AND (f1 IS NULL OR frame <= f1) AND (frame - coalesce(f0, 0)) % coalesce(step, 1) = 0"),
    "stream_activity": """WITH w AS (SELECT 'u' || lpad(CAST(user_id % 16 AS VARCHAR), 2, '0') AS game_id, value, ts, unnest([time_bucket(INTERVAL 3 hours, ts), time_bucket(INTERVAL 3 hours, ts) - INTERVAL 3 hours]) AS start FROM events)
SELECT game_id, start, round(avg(value), 6) AS activity, count(*) AS n FROM w GROUP BY game_id, start HAVING start + INTERVAL 6 hours <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
    "stream_sessions": """WITH e AS (SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS game_id, ts, floor(value) AS d, ts + to_seconds(3600 + CAST(floor(value) AS BIGINT)) AS stop FROM events),
m AS (SELECT *, max(stop) OVER (PARTITION BY game_id ORDER BY ts, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
k AS (SELECT *, sum(CASE WHEN ts < before THEN 0 ELSE 1 END) OVER (PARTITION BY game_id ORDER BY ts, stop ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT game_id, min(ts) AS start, count(*) AS events, round(sum(d), 3) AS duration FROM k GROUP BY game_id, s HAVING max(stop) <= (SELECT max(ts) FROM events) - INTERVAL 1 hour""",
}


def between(source: str, column: str, limit: str, key: str = "game_id, clip, player") -> str:
    """Rows of a numbered source (n) with the column interpolated by number, from its neighbours looked up in each direction."""
    near = lambda order: f"last_value(CASE WHEN {column} IS NOT NULL THEN {{'n': n, 'v': {column}}} END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY n {order} ROWS UNBOUNDED PRECEDING)"
    return f"""{column}_near AS MATERIALIZED (SELECT *, {near("ASC")} AS p, {near("DESC")} AS q FROM {source}),
{column}_full AS (
  SELECT {key}, n, CASE WHEN {column} IS NOT NULL THEN {column} WHEN n - p.n <= {limit.replace("a.", "")} THEN p.v + (q.v - p.v) * (n - p.n) / (q.n - p.n) END AS full_{column} FROM {column}_near)"""


_KEYS = "game_id, clip, player"
_STEPS = f"""gaps AS (SELECT *, lead(frame) OVER (PARTITION BY {_KEYS} ORDER BY frame) - frame AS gap FROM pos),
modes AS (SELECT {_KEYS}, first(gap ORDER BY k DESC, gap) AS step FROM (SELECT {_KEYS}, gap, count(*) AS k FROM gaps WHERE gap IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ends AS (SELECT p.game_id, p.clip, p.player, min(frame) AS a, max(frame) AS b, max(coalesce(step, 1)) AS step FROM pos p LEFT JOIN modes USING ({_KEYS}) GROUP BY ALL),
grid AS (SELECT {_KEYS}, unnest(generate_series(a, b, step)) AS frame FROM ends)"""


def _savgol() -> str:
    """Weights of a quadratic through 11 points: row i - p0 + 1 for the value at place i of the window from p0."""
    import numpy as np

    a = np.vander(np.arange(11) - 5, 3, increasing=True).astype(float)
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in (a @ np.linalg.pinv(a)).tolist()) + "]"


ORACLE |= {
    "overlay_tracks": q(POS, f"""every AS (SELECT {_KEYS}, unnest(generate_series(a, b)) AS frame FROM (SELECT {_KEYS}, min(frame) AS a, max(frame) AS b FROM pos GROUP BY {_KEYS})),
r AS (SELECT every.*, x, y, row_number() OVER (PARTITION BY {_KEYS} ORDER BY frame) AS n FROM every LEFT JOIN pos USING ({_KEYS}, frame))""", between("r", "x", "3"), between("r", "y", "3"),
        select=f"SELECT game_id, clip, player, frame, round(full_x, 10) AS x, round(full_y, 10) AS y FROM r JOIN x_full USING ({_KEYS}, n) JOIN y_full USING ({_KEYS}, n)"),
    "flip_parts": q(POS, _SCORED, """r AS (SELECT game_id, clip, det_id AS tracklet, frame, CASE WHEN count(score) OVER f >= 2 THEN avg(score) OVER f END AS s, row_number() OVER o - 1 AS k, count(*) OVER (PARTITION BY game_id, clip, det_id) AS n
  FROM det WINDOW o AS (PARTITION BY game_id, clip, det_id ORDER BY frame), f AS (PARTITION BY game_id, clip, det_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
l AS (SELECT *, lag(s) OVER (PARTITION BY game_id, clip, tracklet ORDER BY frame) AS before FROM r)""",
        select="""SELECT game_id, clip, tracklet, count(*) FILTER (WHERE k >= 5 AND k < n - 5 AND n >= 10 AND ((before > 0.1001 AND s < -0.1001) OR (before < -0.1001 AND s > 0.1001))) AS cuts FROM l GROUP BY ALL"""),
    "hysteresis_segments": q(POS, wide(), rates(), ACTIVE, """f AS (SELECT game_id, clip, t, round(activity, 6) AS a, row_number() OVER w AS i, count(*) OVER (PARTITION BY game_id, clip) AS n FROM active WHERE t IS NOT NULL WINDOW w AS (PARTITION BY game_id, clip ORDER BY frame)),
st AS (SELECT *, coalesce(last_value(CASE WHEN a > 1.8 THEN 1 WHEN a < 0.9 THEN 0 END IGNORE NULLS) OVER (PARTITION BY game_id, clip ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS s,
  max(CASE WHEN a <= 0.9 THEN i END) OVER (PARTITION BY game_id, clip ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM f),
isl AS (SELECT *, i - row_number() OVER (PARTITION BY game_id, clip, s ORDER BY i) AS k FROM st),
sp AS (SELECT game_id, clip, k, coalesce(arg_min(low, i), 0) + 1 AS lo, least(max(i) + 1, max(n)) AS hi FROM isl WHERE s = 1 GROUP BY ALL),
tm AS (SELECT sp.game_id, sp.clip, x.t AS a, y.t AS b FROM sp JOIN f x ON x.game_id = sp.game_id AND x.clip = sp.clip AND x.i = sp.lo JOIN f y ON y.game_id = sp.game_id AND y.clip = sp.clip AND y.i = sp.hi),
g AS (SELECT *, sum(new) OVER (PARTITION BY game_id, clip ORDER BY a ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY game_id, clip ORDER BY a) < 1.2 THEN 0 ELSE 1 END AS new FROM tm))""",
        select="SELECT game_id, clip, min(a) AS a, max(b) AS b FROM g GROUP BY game_id, clip, m HAVING max(b) - min(a) >= 2.0"),
    "savgol_track": q(POS, rates(), _STEPS, f"""r AS (SELECT grid.*, t, x, y, conf, fps_eff, row_number() OVER (PARTITION BY {_KEYS} ORDER BY frame) AS n FROM grid LEFT JOIN pos USING ({_KEYS}, frame) LEFT JOIN rates USING (game_id, clip))""",
        between("r", "t", "1e9"), between("r", "x", "floor(0.6 * a.fps_eff)"), between("r", "y", "floor(0.6 * a.fps_eff)"), between("r", "conf", "floor(0.6 * a.fps_eff)"),
        f"""m AS (SELECT r.game_id, r.clip, r.player, r.frame, r.n, r.x IS NULL AS interpolated, full_t AS t, full_x AS x, full_y AS y, full_conf AS conf
  FROM r JOIN t_full USING ({_KEYS}, n) JOIN x_full USING ({_KEYS}, n) JOIN y_full USING ({_KEYS}, n) JOIN conf_full USING ({_KEYS}, n)),
v AS (SELECT *, n - row_number() OVER (PARTITION BY {_KEYS}, x IS NOT NULL ORDER BY n) AS run FROM m),
w AS (SELECT {_KEYS}, run, min(n) AS first_n, count(*) AS k, list(x ORDER BY n) AS xs, list(y ORDER BY n) AS ys FROM v WHERE x IS NOT NULL GROUP BY ALL),
u AS (SELECT v.*, k, xs, ys, v.n - first_n + 1 AS i FROM v LEFT JOIN w ON v.x IS NOT NULL AND w.game_id = v.game_id AND w.clip = v.clip AND w.player = v.player AND w.run = v.run),
z AS (SELECT *, greatest(1, least(i - 5, k - 10)) AS p0, {_savgol()} AS wt FROM u),
c AS (SELECT {_KEYS}, frame, n, t, conf, interpolated, least(greatest(CASE WHEN k >= 11 THEN list_inner_product(xs[p0:p0 + 10], wt[i - p0 + 1]) ELSE x END, 0.0), 6.4) AS x0,
  least(greatest(CASE WHEN k >= 11 THEN list_inner_product(ys[p0:p0 + 10], wt[i - p0 + 1]) ELSE y END, 0.0), 9.75) AS y0, x IS NOT NULL AS ok FROM z),
d AS (SELECT * REPLACE (CASE WHEN ok THEN x0 END AS x0, CASE WHEN ok THEN y0 END AS y0), count(*) OVER (PARTITION BY {_KEYS}) AS k FROM c),
e AS (SELECT a.game_id, a.clip, a.player, a.n, CASE WHEN a.k > 1 AND a.ok THEN sqrt(((c.x0 - b.x0) / (c.t - b.t)) ** 2 + ((c.y0 - b.y0) / (c.t - b.t)) ** 2) END AS v0
  FROM d a JOIN d b ON b.game_id = a.game_id AND b.clip = a.clip AND b.player = a.player AND b.n = greatest(a.n - 1, 1) JOIN d c ON c.game_id = a.game_id AND c.clip = a.clip AND c.player = a.player AND c.n = least(a.n + 1, a.k)),
s AS (SELECT * EXCLUDE (v0), CASE WHEN v0 <= 8 THEN v0 END AS v1 FROM e)""", between("s", "v1", "2"),
        select=f"""SELECT game_id, clip, player, frame, round(t, 10) AS t, round(x0, 8) AS x, round(y0, 8) AS y, round(full_v1, 7) AS speed, round(sqrt((x0 - 3.2) ** 2 + (y0 - 5.44) ** 2), 8) AS dist_t, round(conf, 10) AS conf, interpolated
  FROM d JOIN v1_full USING ({_KEYS}, n)"""),
}

# -- the chain from serve clusters to rallies

#: Segments: where a rally begins depends on the pause before, hence the recursion over the cuts of all clusters at once.
_STILL = " AND ".join(f"coalesce(CASE WHEN count({v}) OVER f >= 2 THEN avg({v}) OVER f END, 9.0) < 0.6" for v in ("v1", "v2"))
_KINDS = (("trough", "act < trough_lo", 1.5), ("lull", "act < lull_act", 4.0), ("still", "still", 2.0))
SEGMENTS = f"""stretches_of AS (
  SELECT c.game_id, c.clip, c.t1 AS ts, coalesce(lead(c.t0) OVER (PARTITION BY c.game_id, c.clip ORDER BY c.t0), e.t_max) AS tn, c.server, c.box, c.ambiguous
  FROM clusters c JOIN (SELECT game_id, clip, max(t) AS t_max FROM active GROUP BY ALL) e USING (game_id, clip)),
frames AS MATERIALIZED (SELECT game_id, clip, frame, t, activity AS act, {_STILL} AS still FROM active WINDOW f AS (PARTITION BY game_id, clip ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
inner_rows AS MATERIALIZED (
  SELECT s.game_id, s.clip, s.ts, s.tn, f.t, f.act, f.still, p.trough_lo, p.lull_act, p.act_play, p.min_play_act FROM stretches_of s JOIN frames f ON f.game_id = s.game_id AND f.clip = s.clip AND f.t > s.ts AND f.t < s.tn
  JOIN pace p ON p.game_id = s.game_id AND p.clip = s.clip),
plays AS (SELECT game_id, clip, ts, least(max(t) + 1.0, min(tn) - 0.3) AS over, max(t) FILTER (WHERE act > min_play_act) AS strong FROM inner_rows WHERE act > act_play GROUP BY ALL HAVING max(t) - ts >= 1.0),
early AS (SELECT r.*, row_number() OVER (PARTITION BY game_id, clip, ts ORDER BY t) AS i FROM inner_rows r JOIN plays USING (game_id, clip, ts) WHERE t < over - 1.0),
holding AS MATERIALIZED (""" + " UNION ALL ".join(
    f"""
  SELECT game_id, clip, ts, {no} AS kind, {least} AS least, t, lag(t) OVER w AS prev, max(t) OVER (PARTITION BY game_id, clip, ts, run) AS ends FROM (
    SELECT *, i - row_number() OVER (PARTITION BY game_id, clip, ts ORDER BY t) AS run FROM early WHERE {holds}) WINDOW w AS (PARTITION BY game_id, clip, ts, run ORDER BY t)"""
    for no, (_, holds, least) in enumerate(_KINDS)) + """),
starts AS (
  SELECT game_id, clip, ts, ts AS a, 0 AS no FROM plays WHERE ts < over - 1.0
  UNION ALL SELECT s.game_id, s.clip, s.ts, s.p.ends, s.no + 1 FROM (
    SELECT x.game_id, x.clip, x.ts, x.no, arg_min({'ends': h.ends}, (h.t, h.kind)) AS p FROM starts x JOIN holding h ON h.game_id = x.game_id AND h.clip = x.clip AND h.ts = x.ts
      AND h.t > x.a + 1.5 AND (h.prev IS NULL OR h.prev <= x.a + 1.5) AND h.ends - h.t >= h.least GROUP BY ALL) s
  JOIN plays y ON y.game_id = s.game_id AND y.clip = s.clip AND y.ts = s.ts AND y.strong > s.p.ends AND s.p.ends < y.over - 1.0),
broken AS (
  SELECT x.game_id, x.clip, x.ts, x.a, x.no, min(h.t) AS b FROM starts x LEFT JOIN holding h ON h.game_id = x.game_id AND h.clip = x.clip AND h.ts = x.ts
    AND h.t > x.a + 1.5 AND (h.prev IS NULL OR h.prev <= x.a + 1.5) AND h.ends - h.t >= h.least GROUP BY ALL),
segments AS (
  SELECT k.game_id, k.clip, k.a AS t_start, CASE WHEN k.b IS NULL THEN y.over ELSE coalesce(least(max(r.t) + 1.0, k.b), k.b) END AS t_end, CASE WHEN k.no = 0 THEN s.server END AS server,
    CASE WHEN k.no = 0 THEN s.box END AS box, CASE WHEN k.no > 0 THEN 'serve not detected' WHEN s.ambiguous THEN 'serve ambiguous' ELSE '' END AS note
  FROM broken k JOIN plays y USING (game_id, clip, ts) JOIN stretches_of s USING (game_id, clip, ts)
  LEFT JOIN inner_rows r ON r.game_id = k.game_id AND r.clip = k.clip AND r.ts = k.ts AND r.act > r.act_play AND r.t > k.a AND r.t < k.b
  GROUP BY k.game_id, k.clip, k.ts, k.a, k.no, k.b, y.over, s.server, s.box, s.ambiguous HAVING CASE WHEN k.b IS NULL THEN y.over ELSE coalesce(least(max(r.t) + 1.0, k.b), k.b) END - k.a >= 2.0)"""


def ways(rallies: str, name: str) -> str:
    """name: the rallies with the highest activity inside and the players' ways."""
    step = lambda p: f"sqrt((x{p} - lag(x{p}) OVER w) ** 2 + (y{p} - lag(y{p}) OVER w) ** 2) AS s{p}"
    return f"""{name}_rows AS (
  SELECT r.game_id, r.clip, r.t_start, r.t_end, a.activity, {step(1)}, {step(2)} FROM {rallies} r JOIN active a ON a.game_id = r.game_id AND a.clip = r.clip AND a.t BETWEEN r.t_start AND r.t_end
  WINDOW w AS (PARTITION BY r.game_id, r.clip, r.t_start, r.t_end ORDER BY a.frame)),
{name} AS (
  SELECT r.*, w.top, coalesce(w.way1, 0) AS way1, coalesce(w.way2, 0) AS way2, w.way1 AS known, p.act_play, p.min_play_act, p.relax_slow FROM {rallies} r
  LEFT JOIN (SELECT game_id, clip, t_start, t_end, max(activity) AS top, coalesce(sum(s1), 0) AS way1, coalesce(sum(s2), 0) AS way2 FROM {name}_rows GROUP BY ALL) w USING (game_id, clip, t_start, t_end)
  JOIN pace p USING (game_id, clip))"""


_WIDE_Y = f"BETWEEN {5.44 - 0.6!r}::DOUBLE AND {5.44 + 1.6 + 0.6!r}::DOUBLE"
_WIDE_BOX = f"CASE WHEN {{x}} BETWEEN -0.6 AND {1.6 + 0.6!r}::DOUBLE AND {{y}} {_WIDE_Y} THEN 'left' WHEN {{x}} BETWEEN {6.4 - 1.6 - 0.6!r}::DOUBLE AND {6.4 + 0.6!r}::DOUBLE AND {{y}} {_WIDE_Y} THEN 'right' END"


def relaxed(s: str, o: str) -> str:
    """Box of a relaxed serve of player s, where the other waits for it; else NULL."""
    box = _WIDE_BOX.format(x="x" + s, y="y" + s)
    return f"CASE WHEN (({box}) = 'left' AND x{o} > 3.5 OR ({box}) = 'right' AND x{o} < 2.9000000000000004) AND y{o} > 3.9400000000000004 THEN {box} END"


INFERRED = ways("segments", "moved") + f""",
idle AS (SELECT *, server IS NULL AND coalesce(coalesce(top, 0) < min_play_act OR t_end - t_start < 3.0 OR least(known, way2) < 2.5, TRUE) AS dropped FROM moved),
tried AS (SELECT i.game_id, i.clip, i.t_start, i.t_end, i.min_play_act, a.* EXCLUDE (game_id, clip) FROM idle i JOIN active a ON a.game_id = i.game_id AND a.clip = i.clip
  AND a.t BETWEEN i.t_start AND least(i.t_start + 12.0, i.t_end - 1.0) AND a.t <= i.t_end WHERE i.server IS NULL AND NOT i.dropped),
upto AS (SELECT *, min(t) FILTER (WHERE activity > min_play_act) OVER (PARTITION BY game_id, clip, t_start, t_end) AS stop FROM tried),
stances AS (SELECT *, CASE WHEN v1 < 4 THEN {relaxed("2", "1")} END AS two, CASE WHEN v2 < 4 THEN {relaxed("1", "2")} END AS one FROM upto WHERE stop IS NULL OR t <= stop),
hits AS (SELECT game_id, clip, t_start, t_end, max(t) AS t, arg_max(CASE WHEN two IS NOT NULL THEN 'p2' ELSE 'p1' END, t) AS server, arg_max(coalesce(two, one), t) AS box FROM stances WHERE coalesce(two, one) IS NOT NULL GROUP BY ALL),
inferred AS (
  SELECT i.game_id, i.clip, coalesce(h.t, i.t_start) AS t_start, i.t_end, coalesce(i.server, h.server) AS server, coalesce(i.box, h.box) AS box,
    CASE WHEN i.dropped THEN 'no serve detected and no two-player play' WHEN h.t IS NOT NULL THEN 'serve inferred' ELSE i.note END AS note, i.dropped FROM idle i LEFT JOIN hits h USING (game_id, clip, t_start, t_end))"""


def split(rallies: str) -> str:
    """parts: long rallies split at quiet moments, one accepted cut after the other."""
    return f"""calm AS (SELECT *, max(activity) OVER (PARTITION BY game_id, clip ORDER BY CAST(round(t * 1000) AS BIGINT) RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS top FROM active JOIN pace USING (game_id, clip)),
ready AS (SELECT *, CASE WHEN v1 <= relax_slow OR v1 IS NULL THEN {relaxed("1", "2")} END AS one, CASE WHEN v2 <= relax_slow OR v2 IS NULL THEN {relaxed("2", "1")} END AS two FROM calm WHERE top < act_play),
quiet AS MATERIALIZED (
  SELECT r.game_id, r.clip, r.t_start, r.t_end, q.t, CASE WHEN one IS NOT NULL THEN 'p1' ELSE 'p2' END AS server, coalesce(one, two) AS box FROM {rallies} r
  JOIN ready q ON q.game_id = r.game_id AND q.clip = r.clip AND q.t BETWEEN r.t_start + 4.0 AND r.t_end - 3.0 WHERE r.t_end - r.t_start >= 16.0 AND coalesce(one, two) IS NOT NULL),
taken AS (
  SELECT game_id, clip, t_start, t_end, min(t) AS t, 1 AS no FROM quiet GROUP BY ALL
  UNION ALL SELECT k.game_id, k.clip, k.t_start, k.t_end, min(q.t), k.no + 1 FROM taken k JOIN quiet q ON q.game_id = k.game_id AND q.clip = k.clip AND q.t_start = k.t_start AND q.t_end = k.t_end AND q.t - k.t >= 4.0 GROUP BY ALL),
cut_at AS (SELECT k.*, q.server, q.box, lead(k.t) OVER (PARTITION BY k.game_id, k.clip, k.t_start, k.t_end ORDER BY k.t) AS next_t FROM taken k JOIN quiet q USING (game_id, clip, t_start, t_end, t)),
parts AS (SELECT * FROM (
  SELECT r.game_id, r.clip, r.t_start, coalesce(c.t - 0.5, r.t_end) AS t_end, r.server, r.box, r.note FROM {rallies} r LEFT JOIN cut_at c ON c.game_id = r.game_id AND c.clip = r.clip AND c.t_start = r.t_start AND c.t_end = r.t_end AND c.no = 1
  UNION ALL SELECT game_id, clip, t, coalesce(next_t - 0.5, t_end), server, box, 'serve inferred (quiet moment)' FROM cut_at) WHERE t_end - t_start >= 2.0)"""


REASON = "CASE WHEN t_end - t_start < 2.5 THEN 'too short' WHEN coalesce(top, 0) < 1.2 * act_play THEN 'never reached play' WHEN least(way1, way2) < 2.0 AND t_end - t_start < 4.0 THEN 'one player did not move' END"
_CHAIN = (*_SERVE, CLUSTERS, SEGMENTS)
_PART = "game_id, clip, t_start, t_end, server, box, note"


def rec(*parts: str, select: str) -> str:
    return q(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLE |= {
    "segment_rallies": rec(*_CHAIN, select=f"SELECT {_PART} FROM segments"),
    "infer_missed_serves": rec(*_CHAIN, INFERRED, select=f"SELECT {_PART}, dropped FROM inferred"),
    "dropped_segments": rec(*_CHAIN, ways("segments", "moved"), select=f"SELECT {_PART}, {REASON} AS reason FROM moved WHERE ({REASON}) IS NOT NULL"),
    "split_long_rallies": rec(*_SERVE[:-1], RAL, "long AS (SELECT game_id, clip, t_start, t_end, server, box, coalesce(note, '') AS note FROM ral)", split("long"), select=f"SELECT {_PART} FROM parts"),
    "detected_rallies": rec(*_CHAIN, INFERRED, "kept AS (SELECT * FROM inferred WHERE NOT dropped)", split("kept"), ways("parts", "seen_parts"), f"""good AS (
  SELECT {_PART}, row_number() OVER (PARTITION BY game_id, clip ORDER BY t_start, t_end) AS rally FROM seen_parts WHERE ({REASON}) IS NULL),
n AS (SELECT *, lead(server) OVER w AS ns, lead(box) OVER w AS nb, lead(rally) OVER w IS NULL AS is_last, t_start - lag(t_end) OVER w AS rest FROM good WINDOW w AS (PARTITION BY game_id, clip ORDER BY t_start)),
k AS (SELECT *, CASE WHEN server IS NULL OR is_last OR ns IS NULL OR (ns = server AND nb IS NOT DISTINCT FROM box) THEN NULL ELSE ns END AS w0 FROM n),
b AS (SELECT *, coalesce(count(*) FILTER (WHERE w0 = 'p1') OVER u, 0) AS a1, coalesce(count(*) FILTER (WHERE w0 = 'p2') OVER u, 0) AS a2 FROM k WINDOW u AS (PARTITION BY game_id, clip ORDER BY rally ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, CASE WHEN is_last AND server IS NOT NULL THEN (CASE WHEN a1 = 14 AND a2 < 14 THEN 'p1' WHEN a2 = 14 AND a1 < 14 THEN 'p2' END) ELSE w0 END AS winner FROM b)""",
        select="""SELECT game_id, clip, round(t_start, 3) AS t_start, round(t_end, 3) AS t_end, server, box, concat_ws('; ', nullif(note, ''), nullif(CASE WHEN server IS NULL THEN 'no serve seen' WHEN winner IS NOT NULL THEN ''
  WHEN is_last THEN 'last rally: winner unknown' WHEN ns = server AND nb IS NOT DISTINCT FROM box THEN 'let (same server, same box)' ELSE 'next serve not seen: winner unknown' END, '')) AS note, rally,
  round(t_end - t_start, 3) AS duration, winner, a1 + CAST(coalesce(winner = 'p1', FALSE) AS BIGINT) AS score_p1, a2 + CAST(coalesce(winner = 'p2', FALSE) AS BIGINT) AS score_p2, round(rest, 3) AS rest_before FROM e"""),
    "summary_fields": f"""SELECT g.game_id, g.clip, g.n_rallies, round(g.longest_rally_s, 6) AS longest_rally_s, count(p.player) AS players, max(p.points_won) FILTER (WHERE p.player = 'p1') AS won_p1,
  max(p.points_won) FILTER (WHERE p.player = 'p2') AS won_p2 FROM ({ORACLE["game_summary"]}) g LEFT JOIN ({ORACLE["player_points"]}) p USING (game_id, clip) GROUP BY ALL""",
    "p2_plain": q(POS, """long AS (
  SELECT game_id, clip, player, frame, 'x' AS m, x AS v, 0.0 AS lo, 6.4::DOUBLE AS hi FROM newest UNION ALL SELECT game_id, clip, player, frame, 'y', y, 0.0, 9.75 FROM newest
  UNION ALL SELECT game_id, clip, player, frame, 'speed', speed, 0.0, 1.7976931348623157e308::DOUBLE FROM newest),
known AS (SELECT * REPLACE (CASE WHEN NOT isnan(v) THEN v END AS v) FROM long),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY game_id, clip, player, m ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY game_id, clip, player, m ORDER BY frame) THEN 0 ELSE 1 END AS new FROM known)),
judged AS (SELECT *, CASE WHEN v < lo OR v > hi THEN 'range' WHEN v IS NOT NULL AND count(*) OVER (PARTITION BY game_id, clip, player, m, run) >= 8 THEN 'stuck' END AS fault FROM numbered)""",
        select="""SELECT game_id, clip, player, frame, max(fault) FILTER (WHERE m = 'x') AS x_fault, max(fault) FILTER (WHERE m = 'y') AS y_fault, max(fault) FILTER (WHERE m = 'speed') AS speed_fault
  FROM judged GROUP BY game_id, clip, player, frame HAVING count(fault) > 0"""),
    "p4_periods": q(POS, """r AS (SELECT game_id, clip, player, CAST(floor(t * 2) AS BIGINT) AS k, count(*) AS n FROM newest
  WHERE isfinite(t) AND NOT isnan(x) AND NOT isnan(y) AND NOT coalesce(interpolated, FALSE) GROUP BY ALL),
e AS (SELECT game_id, clip, player, unnest(generate_series(min(k), max(k))) AS k FROM r GROUP BY game_id, clip, player)""",
        select="SELECT e.game_id, e.clip, e.player, e.k AS period_no, coalesce(n, 0) AS n_readings, n IS NULL AS missing FROM e LEFT JOIN r USING (game_id, clip, player, k)"),
}
ORACLE |= {
    "stream_versions": q(POS, select="SELECT game_id, clip, player, frame, x, speed FROM newest"),
    "stream_score": q(RAL, """n AS (SELECT *, lead(server) OVER w AS ns, lead(box) OVER w AS nb, lead(rally) OVER w AS next_rally FROM ral WINDOW w AS (PARTITION BY game_id, clip ORDER BY rally)),
k AS (SELECT game_id, clip, rally, CASE WHEN ns <> server OR (ns = server AND nb IS DISTINCT FROM box) THEN ns END AS winner FROM n WHERE next_rally IS NOT NULL)""",
        select="""SELECT game_id, clip, rally, winner, CAST(count(*) FILTER (WHERE winner = 'p1') OVER w AS INT) AS score_p1, CAST(count(*) FILTER (WHERE winner = 'p2') OVER w AS INT) AS score_p2
  FROM k WINDOW w AS (PARTITION BY game_id, clip ORDER BY rally ROWS UNBOUNDED PRECEDING)"""),
}

_DETECTED = """det_rows AS (
  SELECT *, frame * 2 + side AS det_id, frame * 7 + clip * 3 + side * 5 AS k FROM (SELECT *, CASE player WHEN 'p1' THEN 0 ELSE 1 END AS side FROM pos WHERE player IN ('p1', 'p2')))"""
_D = ", ".join(f"CASE WHEN k % 8 <> 0 THEN (k * {3 + i}) % 83 / 83.0 END AS d{i}" for i in (2, 9))
ORACLE |= {
    "spectator_filter": q(POS, _DETECTED, """p AS (SELECT *, CASE WHEN k % 10 <> 0 THEN (k * 29) % 101 / 101.0 END AS prob_p1, CASE WHEN k % 10 <> 0 THEN (k * 37) % 59 / 118.0 END AS prob_p2,
  CASE WHEN k % 10 <> 0 THEN (k * 31) % 53 / 90.0 END AS prob_other FROM det_rows)""",
        select="""SELECT game_id, clip, player, frame, round(prob_p1 - prob_p2, 6) AS score,
  round(conf * CASE WHEN feet_cut THEN 0.5 ELSE 1.0 END * CASE WHEN ankle_vis THEN 1.0 ELSE 0.8 END * greatest(0.55, least(1.0, 1 - (y - 7.0) / 5.0)), 12) AS pos_conf
  FROM p WHERE NOT coalesce(prob_other > 0.5, FALSE) AND x > -0.45 AND x < 6.4 + 0.45 AND y > -0.45 AND y < 9.75 + 0.8"""),
    "identity_features": q(POS, _DETECTED, f"""raw AS (
  SELECT game_id, clip, det_id, k, side, frame, CASE WHEN k % 9 <> 0 THEN k * 5 % 97 + (1 - side) * 60 END AS chest_s,
    CASE WHEN k % 9 <> 0 THEN [CASE WHEN k % 4 <> 0 THEN k * 3 % 180 END, CASE WHEN k % 6 <> 0 THEN k * 17 % 180 END] END AS hs, CASE WHEN k % 9 <> 0 THEN [CASE WHEN k % 4 <> 0 THEN k * 5 % 89 END, CASE WHEN k % 6 <> 0 THEN k * 19 % 89 END] END AS vs,
    CASE WHEN k % 8 <> 0 THEN k * 23 % 67 END AS shorts_s, {_D}, CASE WHEN k % 5 <> 0 THEN k * 11 % 53 / 53.0 END AS c1, CASE WHEN k % 7 <> 0 THEN frame // 40 * 2 + side END AS tracklet FROM det_rows),
f AS (SELECT * REPLACE (chest_s::DOUBLE AS chest_s, shorts_s::DOUBLE AS shorts_s), list_avg(hs)::DOUBLE AS th_h, list_avg(vs)::DOUBLE AS th_v FROM raw),
m AS (SELECT *, {", ".join(f"coalesce({c}, median({c}) OVER (PARTITION BY game_id)) AS f_{c}" for c in ("chest_s", "th_h", "th_v", "shorts_s", "d2", "d9"))}, c1 AS f_c1 FROM f)""",
        select="SELECT game_id, clip, det_id, tracklet, CASE WHEN tracklet IS NULL OR tracklet % 3 = 2 THEN -1 WHEN tracklet % 5 = 0 THEN 2 WHEN tracklet % 2 = 0 THEN 1 ELSE 0 END AS class, "
        + ", ".join(f"round((f_{c} - avg(f_{c}) OVER g) / (stddev_samp(f_{c}) OVER g + 1e-9), 6) AS {c}" for c in ("chest_s", "th_h", "th_v", "shorts_s", "d2", "d9", "c1")) + " FROM m WINDOW g AS (PARTITION BY game_id)"),
    "patch_colours": q(POS, _DETECTED, """cells AS (SELECT game_id, clip, det_id, r.i * 18 + c.i * 3 AS byte_no FROM det_rows, (SELECT unnest([3, 4, 5]) AS i) r, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i) c
  WHERE det_id % 10 <> 0 AND abs(c.i - det_id % 6) <= 1),
v AS (SELECT game_id, clip, det_id, """ + ", ".join(f"median((det_id * 7 + (byte_no + {j}) * ((byte_no + {j}) % 3 + 5)) % 120)::DOUBLE AS chest_{c}" for j, c in enumerate("hsv")) + " FROM cells GROUP BY ALL)",
        select="SELECT game_id, clip, det_id, chest_h, chest_s, chest_v FROM det_rows LEFT JOIN v USING (game_id, clip, det_id)"),
}


def _blur(axis: str, size: int) -> str:
    """Weights of a Gaussian blur (deviation 1.2) from each cell to each other, mirrored at the ends."""
    return f"""blur_{axis} AS (SELECT CASE WHEN m < {size} THEN m ELSE {2 * size - 1} - m END AS a, b, sum(w) AS w FROM (
  SELECT (b + o + {2 * size}) % {2 * size} AS m, b, exp(-0.5 * (o / 1.2) ** 2) / (SELECT sum(exp(-0.5 * (i / 1.2) ** 2)) FROM range(-5, 6) r(i)) AS w FROM range({size}) c(b), range(-5, 6) k(o)) GROUP BY ALL)"""


_SHOWN = ("t_share_1_5m", "mean_dist_t", "distance_rally_m", "mean_speed")
ORACLE |= {
    "smoothed_heatmap": f"WITH bins AS ({ORACLE['heatmap_bins']}),\n" + _blur("y", 39) + ",\n" + _blur("x", 26) + """,
h AS (SELECT game_id, player, y.b AS yb, x.b AS xb, sum(n * y.w * x.w) AS v FROM bins JOIN blur_y y ON y.a = bins.yb JOIN blur_x x ON x.a = bins.xb GROUP BY ALL)
SELECT game_id, player, yb, xb, round(v / sum(v) OVER (PARTITION BY game_id, player) * 100, 8) AS percent FROM h""",
    "t_timeline": q(POS, RAL, "s AS (SELECT game_id, clip, min(t_start) - 5 AS a, max(t_end) + 5 AS b FROM ral GROUP BY ALL)",
        select="""SELECT p.game_id, p.clip, p.player, p.frame, p.t, p.dist_t, CAST(k AS INT) AS panel, r.rally FROM pos p JOIN s USING (game_id, clip) JOIN range(3) g(k) ON p.t >= a + (b - a) * k / 3 AND p.t <= a + (b - a) * (k + 1) / 3
  LEFT JOIN ral r ON r.game_id = p.game_id AND r.clip = p.clip AND p.t BETWEEN r.t_start AND r.t_end"""),
    "trajectories": q(POS, RAL, "r AS (SELECT *, row_number() OVER (PARTITION BY game_id, clip ORDER BY rally) - 1 AS i FROM ral)",
        select="""SELECT p.game_id, p.clip, p.player, r.rally, i // 6 AS row, i % 6 AS column, count(*) AS points, first(p.x ORDER BY p.frame) AS x, first(p.y ORDER BY p.frame) AS y
  FROM pos p JOIN r ON r.game_id = p.game_id AND r.clip = p.clip AND p.t BETWEEN r.t_start AND r.t_end GROUP BY p.game_id, p.clip, p.player, r.rally, i"""),
    "comparison": f"WITH m AS ({ORACLE['player_movement']})\n" + " UNION ALL ".join(
        f"SELECT game_id, clip, '{c}' AS metric, max({c}) FILTER (WHERE player = 'p1') AS p1, max({c}) FILTER (WHERE player = 'p2') AS p2, round(max({c}) FILTER (WHERE player = 'p1') - max({c}) FILTER (WHERE player = 'p2'), 5) AS difference FROM m GROUP BY ALL"
        for c in _SHOWN),
    "pair_quality": q(POS, _SCORED, "two AS (SELECT game_id, clip, frame, min(score) FILTER (WHERE det_id = 1) AS a, min(score) FILTER (WHERE det_id = 2) AS b FROM det GROUP BY ALL HAVING count(*) = 2)",
        select="SELECT game_id, clip, count(*) AS pairs, " + ", ".join(f"round(quantile_cont(abs(a - b), {v / 100}), 6) AS gap_{v}" for v in (10, 50, 90)) + ", round(avg(CAST(sign(a) * sign(b) < 0 AS INT)), 6) AS opposite_share FROM two GROUP BY game_id, clip"),
    "frame_detections": f"WITH o AS ({ORACLE['overlay_tracks']}),\n" + POS + ",\n" + _DETECTED + """,
g AS (SELECT game_id, clip, frame, count(x) AS tracked FROM o GROUP BY ALL), f AS (SELECT game_id, clip, frame, count(*) AS detections, min(det_id) AS first FROM det_rows GROUP BY ALL)
SELECT game_id, clip, frame, tracked, coalesce(detections, 0) AS detections, first FROM g LEFT JOIN f USING (game_id, clip, frame)""",
    "background_frames": """WITH g AS (SELECT DISTINCT ON (game_id) game_id, fps, coalesce(CASE WHEN NOT isnan(t_start) THEN t_start END, 0) + 10 AS a, CASE WHEN NOT isnan(t_end) THEN t_end END - 10 AS b FROM games WHERE game_id IS NOT NULL),
s AS (SELECT game_id, fps, CAST(i AS INT) AS sample, a + (b - a) * i / 59 AS t FROM g, range(60) r(i) WHERE fps IS NOT NULL AND NOT isnan(fps) AND b IS NOT NULL)
SELECT game_id, sample, round(t, 6) AS t, CAST(floor(t * fps) AS BIGINT) AS frame FROM s""",
}
ORACLE["floor_fit"] = """SELECT court, line, CAST(61 AS BIGINT) AS pixels, TRUE AS close, TRUE AS lens_found FROM (SELECT DISTINCT court FROM games WHERE court IS NOT NULL),
  (SELECT unnest(['x = 0.0', 'x = 1.6', 'x = 3.2', 'x = 4.8', 'x = 6.4', 'y = 0.5', 'y = 5.44', 'y = 7.04', 'y = 9.75']) AS line)"""
