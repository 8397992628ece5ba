"""Registered queries of the core: name -> (spark, sf_dir) -> DataFrame. Every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyforge.functions import camera, court
from rallyforge.functions import text as text_fn
from rallyforge.operators import asof, charts, features, identity, islands, learning, metrics, rallies, regular_grid, serves, signals, spikes, track, vision
from rallyforge.plans.derived import identity_tables
from rallyforge.session import cut_lineage, lookup, own_folder, stored
from rallyforge.sources import files
from rallyforge.sources.tables import clean_positions, clean_rallies, game_strides, of_sources, table
from rallyforge.streaming import live

CLIP, WHO = signals.CLIP, metrics.WHO
#: A calibration to project with (no table ships one).
LENS = camera.Lens(-0.18, 310.0, 236.0, 395.0)
CALIBRATION = camera.Calibration(((0.018, 0.0, -1.5), (0.0, 0.027, -4.2), (0.0, 0.0012, 1.0)), LENS)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _pos(spark: SparkSession, d: str) -> DataFrame:
    return clean_positions(table(spark, d, "positions"))


def _rallies(spark: SparkSession, d: str) -> DataFrame:
    return clean_rallies(table(spark, d, "rallies"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return signals.side_by_side(_pos(spark, d))


def _inside(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rows_in_rallies(_wide(spark, d), _rallies(spark, d))


def _players(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_player(_inside(spark, d))


# -- problems of the core


def p2_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_faults(table(spark, d, "positions"), table(spark, d, "games"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_flags(spark, d).select("game_id", "clip", "player", "frame")


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    """Of the flags those for ranges and constant series, which plain SQL can tell."""
    kinds = {f"{m}_fault": F.when(F.col(f"{m}_fault") != "spike", F.col(f"{m}_fault")) for m in ("x", "y", "speed")}
    return p2_flags(spark, d).withColumns(kinds).filter("coalesce(x_fault, y_fault, speed_fault) IS NOT NULL")


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_grid(table(spark, d, "positions"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).filter("missing").select("game_id", "clip", "player", "period_no")


def p4_periods(spark: SparkSession, d: str) -> DataFrame:
    return p4_grid(spark, d).select("game_id", "clip", "player", "period_no", "n_readings", "missing")


# -- geometry and projection


def court_zone_share(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.zone_shares(_pos(spark, d), ["game_id", "player"]), "share")


def court_points(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions of a place: zone, distance to the T, service box with and without pad, receiver position."""
    x, y = F.col("x"), F.col("y")
    rows = _pos(spark, d).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.select(
        *WHO, "frame", court.zone_row(y).alias("zone_row"), court.zone_col(x).alias("zone_col"), F.round(court.dist_to_t(x, y), 4).alias("dist"),
        court.in_box(x, y, "left").alias("in_left"), court.box_of(x, y).alias("box"), court.receiver_ok(x, y, F.lit("left")).alias("waits_for_left"),
        court.receiver_ok(x, y, F.lit("right"), "past_inner_line").alias("past_line_right"), F.round(court.clip(x, 0.0, court.WIDTH), 4).alias("x_clipped"),
    )


def _detections(spark: SparkSession, d: str) -> DataFrame:
    """Detections around the foot points of positions: box and ankles by fixed offsets."""
    p = _pos(spark, d).filter("fx IS NOT NULL AND fy IS NOT NULL")
    fx, fy = F.col("fx"), F.col("fy")
    return p.select(
        *WHO, "frame", "t", (fx - 20).alias("x0"), (fx + 22).alias("x1"), fy.alias("y1"), (fx - 5).alias("lank_x"), (fy - 8).alias("lank_y"), F.col("conf").alias("lank_c"),
        (fx + 6).alias("rank_x"), (fy - 9).alias("rank_y"), (1 - F.col("conf")).alias("rank_c"),
    )


def foot_point_projection(spark: SparkSession, d: str) -> DataFrame:
    made = _detections(spark, d).withColumns(camera.foot_point(430.0))
    return rounded(made.select(*WHO, "frame", "fx", "fy", "ankle_vis", "feet_cut"), "fx", "fy", digits=4)


def lens_undistort(spark: SparkSession, d: str) -> DataFrame:
    ux, uy = camera.undistort(F.col("fx"), F.col("fy"), LENS)
    return _pos(spark, d).select(*WHO, "frame", F.round(ux, 4).alias("ux"), F.round(uy, 4).alias("uy"))


def lens_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Points, their mean distance from where the lens shows them, and the largest error of distorting the undistorted point,
    by player (within the lens's reach)."""
    near = _pos(spark, d).filter(F.hypot(F.col("fx") - LENS.cx, F.col("fy") - LENS.cy) < 300)
    ux, uy = camera.undistort(F.col("fx"), F.col("fy"), LENS)
    px, py = camera.distort(ux, uy, LENS)
    error, shift = F.hypot(px - F.col("fx"), py - F.col("fy")), F.hypot(ux - F.col("fx"), uy - F.col("fy"))
    return near.groupBy("player").agg(F.count("*").alias("n"), F.round(F.avg(shift), 5).alias("mean_shift"), F.round(F.max(error), 6).alias("largest_error"))


def homography_project(spark: SparkSession, d: str) -> DataFrame:
    x, y = camera.to_court(CALIBRATION, F.col("fx"), F.col("fy"))
    return _pos(spark, d).select(*WHO, "frame", F.round(x, 4).alias("cx"), F.round(y, 4).alias("cy"))


def court_to_pixels(spark: SparkSession, d: str) -> DataFrame:
    x, y = camera.to_pixels(CALIBRATION, F.col("x"), F.col("y"))
    return _pos(spark, d).select(*WHO, "frame", F.round(x, 4).alias("px"), F.round(y, 4).alias("py"))


def court_lines(spark: SparkSession, d: str) -> DataFrame:
    return court.court_lines(spark)


# -- signals


def activity_signal(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide(spark, d)
    active = signals.activity(wide, signals.sample_rate(_pos(spark, d)))
    return rounded(active.select(*CLIP, "frame", "t", "activity"), "activity", digits=8)


def sample_rate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.sample_rate(_pos(spark, d)), "fps_eff", digits=4)


def _active(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Frames with their activity, stored since several steps read them, and the thresholds of each clip."""
    pos = _pos(spark, d)
    active = stored(signals.activity(signals.side_by_side(pos), signals.sample_rate(pos)))
    return active, cut_lineage(signals.pace_parameters(active, pos))


def pace_percentiles(spark: SparkSession, d: str) -> DataFrame:
    pos = _pos(spark, d)
    made = signals.pace_parameters(signals.activity(signals.side_by_side(pos), signals.sample_rate(pos)), pos)
    return rounded(made, *(c for c in made.columns if c not in CLIP), digits=5)


def both_players_still(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d).withColumn("still", signals.both_still()).select(*CLIP, "frame", "still")


def gradient_speed(spark: SparkSession, d: str) -> DataFrame:
    dt = signals.gradient("t", track.by_source())
    v = F.hypot(signals.gradient("x", track.by_source()) / dt, signals.gradient("y", track.by_source()) / dt)
    return _pos(spark, d).select(*WHO, "frame", v.alias("v")).withColumn("v", F.round(F.when(F.col("v") <= 8.0, F.col("v")), 4))


def trail_window(spark: SparkSession, d: str) -> DataFrame:
    t = signals.trail(_pos(spark, d))
    return t.select(*WHO, "frame", F.size("trail").cast("bigint").alias("points"), F.round(F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["x"]), 4).alias("sum_x"))


def hysteresis_segments(spark: SparkSession, d: str) -> DataFrame:
    active = signals.activity(_wide(spark, d), signals.sample_rate(_pos(spark, d))).filter("t IS NOT NULL").withColumn("activity", F.round("activity", 6))
    return islands.hysteresis(active, CLIP, ["frame"], "activity", 1.8, 0.9)


# -- serves, rallies, score


def _events(spark: SparkSession, d: str) -> DataFrame:
    active, limits = _active(spark, d)
    return serves.serve_events(active, limits)


def serve_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


def serve_clusters(spark: SparkSession, d: str) -> DataFrame:
    return serves.serve_clusters(_events(spark, d)).drop("ambiguous")


def ambiguous_clusters(spark: SparkSession, d: str) -> DataFrame:
    return serves.serve_clusters(_events(spark, d)).groupBy("game_id").agg(F.count("*").alias("clusters"), F.sum(F.col("ambiguous").cast("bigint")).alias("ambiguous"))


def detected_rallies(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: signals, serves, cuts at pauses, missed serves, long rallies, plausibility, score."""
    active, limits = _active(spark, d)
    clusters = serves.serve_clusters(serves.serve_events(active, limits))
    ends = active.groupBy(*CLIP).agg(F.max("t").alias("clip_end"))
    cut = cut_lineage(rallies.segment(active, clusters, limits, ends))
    kept = rallies.infer_serves(cut, active, limits).filter("NOT dropped").drop("dropped")
    parts = cut_lineage(rallies.split_long(kept, active, limits))
    good = rallies.implausible(parts, active, limits).filter("reason IS NULL").drop("reason")
    scored = serves.score(rallies.numbered(good))
    made = scored.withColumn("note", text_fn.joined(F.col("note"), F.col("score_note"))).withColumn("rest_before", serves.rest_before())
    return rounded(made.drop("score_note"), "t_start", "t_end", "duration", "rest_before", digits=3)


def segment_rallies(spark: SparkSession, d: str) -> DataFrame:
    active, limits = _active(spark, d)
    clusters = serves.serve_clusters(serves.serve_events(active, limits))
    ends = active.groupBy(*CLIP).agg(F.max("t").alias("clip_end"))
    return rallies.segment(active, clusters, limits, ends)


def dropped_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments that cannot be rallies with the reason, of those cut at pauses."""
    active, limits = _active(spark, d)
    return rallies.implausible(segment_rallies(spark, d), active, limits).filter("reason IS NOT NULL")


def infer_missed_serves(spark: SparkSession, d: str) -> DataFrame:
    active, limits = _active(spark, d)
    return rallies.infer_serves(segment_rallies(spark, d), active, limits)


def split_long_rallies(spark: SparkSession, d: str) -> DataFrame:
    """Long rallies of the table, split at serves in quiet moments."""
    active, limits = _active(spark, d)
    rows = _rallies(spark, d).select(*CLIP, "t_start", "t_end", "server", "box", F.coalesce("note", F.lit("")).alias("note"))
    return rallies.split_long(rows, active, limits)


def score_progress(spark: SparkSession, d: str) -> DataFrame:
    made = serves.score(_rallies(spark, d).select(*CLIP, "rally", "t_start", "server", "box"), "rally")
    return made.select(*CLIP, "rally", "winner", "score_p1", "score_p2", F.col("score_note").alias("note"))


def rest_before(spark: SparkSession, d: str) -> DataFrame:
    return _rallies(spark, d).select(*CLIP, "rally", F.round(serves.rest_before("rally"), 3).alias("rest"))


def rally_interval_join(spark: SparkSession, d: str) -> DataFrame:
    return _inside(spark, d).groupBy(*CLIP, "rally").agg(F.count("*").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


def rally_path_length(spark: SparkSession, d: str) -> DataFrame:
    made = rallies.rally_metrics(_rallies(spark, d), _wide(spark, d))
    return rounded(made, *(c for c in made.columns if c not in (*CLIP, "rally")), digits=5)


# -- metrics


def player_movement(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.movement(_players(spark, d))
    return rounded(made, *(c for c in made.columns if c not in (*WHO, "frames_in_rally")), digits=5)


def heatmap_bins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.heatmap(_players(spark, d), ["game_id", "player"])


def speed_histogram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.speed_histogram(_players(spark, d), ["player"]), "density", digits=8)


def excursion_recovery(spark: SparkSession, d: str) -> DataFrame:
    made = islands.excursions(_players(spark, d).filter("t IS NOT NULL"), WHO, ["frame"], F.col("dist_t") > 1.5)
    return rounded(made, "recovery_s", digits=4)


def speed_bursts(spark: SparkSession, d: str) -> DataFrame:
    rows = _players(spark, d).filter("t IS NOT NULL")
    # a float difference of exactly half a second may fall on either side of it
    return islands.bursts(rows, WHO, ["frame"], F.coalesce("speed", F.lit(0.0)) > 3.0, least_s=0.5 - 1e-6)


def longest_streak(spark: SparkSession, d: str) -> DataFrame:
    return metrics.longest_streaks(_rallies(spark, d))


def player_points(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.points(_rallies(spark, d))
    return rounded(made, *(c for c in made.columns if c.startswith(("mean", "distance"))), digits=5)


def serve_by_box(spark: SparkSession, d: str) -> DataFrame:
    return metrics.serve_by_box(_rallies(spark, d))


def game_summary(spark: SparkSession, d: str) -> DataFrame:
    made = metrics.game_summary(_rallies(spark, d))
    return rounded(made, "mean_rally_s", "median_rally_s", "total_rally_s", "total_rest_s", "mean_rest_s", "work_rest_ratio", digits=5)


def separation_crowding(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.separation(_inside(spark, d)), "mean_separation_m", "crowding_share", digits=5)


def track_reliability(spark: SparkSession, d: str) -> DataFrame:
    pos = _pos(spark, d)
    return rounded(metrics.reliability(pos, _inside(spark, d), signals.sample_rate(pos)), "feet_cut_share", "interpolated_share", "tracked_share")


def frame_rate(spark: SparkSession, d: str) -> DataFrame:
    """Readings a second by frame numbers and strides."""
    rows = lookup(_pos(spark, d), game_strides(table(spark, d, "games")), ["game_id"]).withColumn("stride", F.coalesce("stride", F.lit(1)))
    return rounded(signals.rate_of_frames(rows), "fps_eff")


def rally_table(spark: SparkSession, d: str) -> DataFrame:
    """Rallies as a report shows them."""
    return _rallies(spark, d).select(
        *CLIP, "rally", text_fn.mmss(F.col("t_start")).alias("start"), text_fn.number(F.col("duration"), 3, " s").alias("length"), text_fn.percent(F.col("tshare_p1"), 1).alias("t_p1"),
        text_fn.joined(F.initcap("server"), F.col("box"), by=" ").alias("serve"), F.coalesce(F.nullif("note", F.lit("")), F.lit(text_fn.DASH)).alias("note"),
    )


# -- charts


def smoothed_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.smoothed_heatmap(heatmap_bins(spark, d), ["game_id", "player"]), "percent", digits=8)


def t_timeline(spark: SparkSession, d: str) -> DataFrame:
    return charts.t_timeline(_pos(spark, d), _rallies(spark, d))


def trajectories(spark: SparkSession, d: str) -> DataFrame:
    made = charts.trajectories(_pos(spark, d), _rallies(spark, d))
    return made.select(*WHO, "rally", "row", "column", F.size("path").cast("bigint").alias("points"), F.col("at_serve.x").alias("x"), F.col("at_serve.y").alias("y"))


def comparison(spark: SparkSession, d: str) -> DataFrame:
    made = player_movement(spark, d)  # as shown, so differences are those of the shown numbers
    return rounded(charts.comparison(made, ["t_share_1_5m", "mean_dist_t", "distance_rally_m", "mean_speed"]), "p1", "p2", "difference", digits=5)


# -- tracks


def gap_interpolation(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d).select(*WHO, "frame", "x", "y").withColumn("__x", F.col("x"))
    made = track.on_grid(rows, {"x": 6, "y": 6, "__x": 0}).select(*WHO, "frame", F.col("__x").isNull().alias("interpolated"), "x", "y")
    return rounded(made, "x", "y", digits=10)


def savgol_track(spark: SparkSession, d: str) -> DataFrame:
    pos = _pos(spark, d)
    rates = signals.sample_rate(pos)
    made = track.smooth_tracks(pos.select(*WHO, "frame", "t", "x", "y", "conf"), rates)
    return rounded(rounded(rounded(made, "t", "conf", digits=10), "x", "y", "dist_t", digits=8), "speed", digits=7)


def overlay_tracks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(track.every_frame(_pos(spark, d)), "x", "y", digits=10)


# -- lookups in time


def score_asof(spark: SparkSession, d: str) -> DataFrame:
    return asof.score_at(_wide(spark, d).select(*CLIP, "frame", "t"), _rallies(spark, d))


def rally_asof(spark: SparkSession, d: str) -> DataFrame:
    return asof.rally_at(_wide(spark, d).select(*CLIP, "frame", "t").filter("t IS NOT NULL"), _rallies(spark, d)).drop("t")


def frames_near_rallies(spark: SparkSession, d: str) -> DataFrame:
    return asof.near_rallies(_wide(spark, d).select(*CLIP, "frame", "t"), _rallies(spark, d)).groupBy(*CLIP).agg(F.count("*").alias("frames"))


def review_topk(spark: SparkSession, d: str) -> DataFrame:
    return asof.review(_rallies(spark, d), table(spark, d, "games").select("game_id", "user_player"))


# -- identity


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Detections of a frame as tracklets (one per source) with a score: the side of the court."""
    rows = _pos(spark, d).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.select(
        "game_id", "clip", "frame", "x", "y", "conf", F.when(F.col("player") == "p1", 1).otherwise(2).cast("bigint").alias("det_id"),
        (F.when(F.col("player") == "p1", 0).otherwise(1_000_000) + F.floor(F.col("frame") / 40)).alias("tracklet"), ((F.col("x") - court.T_X) / 3.0).alias("score"),
    )


def tracklet_labels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(identity.tracklet_labels(_scored(spark, d), CLIP), "s", "conf", "weight", digits=9)


def tracklet_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(identity.tracklet_stats(identity.tracklet_labels(_scored(spark, d), CLIP), CLIP), "weighted_abs_score", digits=8)


def conflict_resolver(spark: SparkSession, d: str) -> DataFrame:
    rows = _scored(spark, d)
    labels = identity.tracklet_labels(rows, CLIP).select(*CLIP, "tracklet", "label", F.round("weight", 8).alias("weight"))
    return identity.resolve_frames(rows.join(labels, [*CLIP, "tracklet"]), CLIP).select(*CLIP, "frame", "det_id", "label", "player")


def flip_parts(spark: SparkSession, d: str) -> DataFrame:
    made = identity.split_on_flips(_scored(spark, d).withColumn("tracklet", F.col("det_id")), CLIP, margin=0.1001)
    return made.groupBy(*CLIP, "tracklet").agg(F.max("part").cast("bigint").alias("cuts"))


def build_tracklets(spark: SparkSession, d: str) -> DataFrame:
    """Tracklets from the readings of both players as unlabelled detections, at the stride of each game."""
    rows = lookup(_scored(spark, d).drop("tracklet", "score"), game_strides(table(spark, d, "games")), ["game_id"])
    return identity.build_tracklets(rows.withColumn("stride", F.coalesce("stride", F.lit(1))), CLIP).select(*CLIP, "frame", "det_id", "tracklet")


def class_membership(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "tracklets_tmp").filter("det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1").distinct()
    classes = identity.class_of(table(spark, d, "tracklet_labels"), ["game_id"])
    joined = links.join(classes, ["game_id", "tracklet"], "left").withColumn("class", F.coalesce("class", F.lit(-1)))
    return joined.groupBy("game_id", "class").agg(F.countDistinct("tracklet").alias("tracklets"), F.count("*").alias("links"))


def spectator_filter(spark: SparkSession, d: str) -> DataFrame:
    """Detections joined with their identity probabilities: who is kept, with what score and confidence."""
    pos = _pos(spark, d)
    rows = pos.withColumn("det_id", F.col("frame") * 2 + F.when(F.col("player") == "p1", 0).otherwise(1)).filter(F.col("player").isin("p1", "p2"))
    rows = rows.join(identity_tables(pos)["probs"], [*CLIP, "det_id"], "left")
    kept = rows.filter(identity.players_only() & identity.in_court_window())
    return kept.select(*WHO, "frame", F.round(identity.identity_score(), 6).alias("score"), F.round(identity.position_confidence(), 12).alias("pos_conf"))


DET, SHOWN = [*CLIP, "det_id"], ["chest_s", "th_h", "th_v", "shorts_s", "d2", "d9", "c1"]


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """Features of all detections as z-scores of their game, with tracklet and class, and their names."""
    made = identity_tables(stored(_pos(spark, d).select(*WHO, "frame", "t", "conf")), in_place=True)
    table_, by_hand, learned = features.feature_table(made["detections"], made["patches"], made["appearance"], made["cnn"], DET, n_c=4)
    classes = cut_lineage(identity.class_of(made["labels"], CLIP))
    labelled = stored(features.with_labels(table_, made["tracklets"], classes, DET, [*CLIP, "tracklet"]).drop("frame", "t", "conf"))
    return features.z_scores(labelled, by_hand + learned, tuple(by_hand), ("game_id",)), by_hand + learned


def identity_features(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _features(spark, d)
    return rounded(rows.select(*DET, "tracklet", "class", *SHOWN), *SHOWN, digits=6)


def identity_model(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the identity model on tracklets that it has not seen, for each detection and each tracklet."""
    rows, names = _features(spark, d)
    known = rows.filter(F.col("class") >= 0).select(
        *CLIP, "tracklet", F.col("class").cast("double").alias("label"), learning.to_vector(F.array(*(F.coalesce(n, F.lit(0.0)) for n in names))).alias("features")
    )
    return learning.accuracy(learning.cross_validate(known, [*CLIP, "tracklet"]), [*CLIP, "tracklet"])


def patch_colours(spark: SparkSession, d: str) -> DataFrame:
    """Colours around the chest in pictures of 8 by 6 pixels that are made from the detections' numbers."""
    made = identity_tables(_pos(spark, d))["detections"]
    pixel = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.chr((F.col("det_id") * 7 + i * (i % 3 + 5)) % 120).cast("binary"))
    rows = made.withColumn("pixels", F.aggregate(pixel, F.lit(b""), lambda a, x: F.concat(a, x)))
    rows = rows.select(*DET, "pixels", F.lit(8).alias("height"), F.lit(6).alias("width"), F.lit(1.0).alias("radius"), F.when(F.col("det_id") % 10 != 0, F.col("det_id") % 6).cast("double").alias("x"), F.lit(4.0).alias("y"))
    return features.patch_colours(rows, DET, {"chest": ("x", "y")})


# -- vectors


def frame_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("grp", F.floor(F.col("vec_id") / 2))
    pairs = features.frame_pairs(rows, ["grp"], "vec_id", "embedding")
    return pairs.select("grp", "a", "b", F.round(features.dot("va", "vb"), 4).alias("dot"))


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("u", features.unit("embedding"))
    return rows.select("vec_id", F.round(features.dot("u", "u"), 6).alias("norm2"), F.round(F.get("u", F.lit(0)), 5).alias("first"))


def pair_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well the side of the court tells the two players of a frame apart, by clip."""
    made = features.pair_quality(_scored(spark, d), ["frame"], "det_id", tuple(CLIP))
    gap = lambda i: F.round(F.get("gaps", F.lit(i)), 6)
    return made.select(*CLIP, "pairs", gap(0).alias("gap_10"), gap(1).alias("gap_50"), gap(2).alias("gap_90"), F.round("opposite_share", 6).alias("opposite_share"))


def frame_detections(spark: SparkSession, d: str) -> DataFrame:
    """Every frame of an overlay with the detections that belong to it."""
    grid = track.every_frame(_pos(spark, d)).groupBy(*CLIP, "frame").agg(F.count("x").alias("tracked"))
    found = identity_tables(_pos(spark, d))["detections"].groupBy(*CLIP, "frame").agg(F.count("*").alias("detections"), F.min("det_id").alias("first"))
    return grid.join(found, [*CLIP, "frame"], "left").select(*CLIP, "frame", "tracked", F.coalesce("detections", F.lit(0)).alias("detections"), "first")


def separating_axis(spark: SparkSession, d: str) -> DataFrame:
    """Two means along the axis that separates the vectors of a pair."""
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL").withColumn("grp", F.floor(F.col("vec_id") / 2))
    size = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    axis = features.separating_axis(features.frame_pairs(rows, ["grp"], "vec_id", "embedding"), size)
    return features.axis_scores(rows, "embedding", axis).select("vec_id", "label", F.round("score", 5).alias("score"))


def feature_z_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = _rallies(spark, d).select(*CLIP, "rally", "duration", "dist_p1", "rest_before")
    made = features.z_scores(rows, ["duration", "dist_p1", "rest_before"], fill=("rest_before",))
    return rounded(made, "duration", "dist_p1", "rest_before")


# -- identity model


def identity_logreg(spark: SparkSession, d: str) -> DataFrame:
    """Cross-validated accuracy, per row and per group by majority, of a model of three classes on the vectors."""
    rows = table(spark, d, "embeddings").filter("embedding IS NOT NULL AND label IS NOT NULL")
    rows = rows.select((F.floor(F.col("vec_id") / 5)).alias("grp"), (F.col("label") % 3).cast("double").alias("label"), learning.to_vector("embedding").alias("features"))
    return learning.accuracy(learning.cross_validate(cut_lineage(rows), ["grp"]), ["grp"])


def fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and groups of each fold: tracklets as groups of links."""
    links = table(spark, d, "tracklets_tmp").filter("det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1").distinct()
    folds = learning.group_folds(links, ["game_id", "tracklet"])
    return links.join(folds, ["game_id", "tracklet"]).groupBy("fold").agg(F.count("*").alias("links"), F.countDistinct("game_id", "tracklet").alias("tracklets"))


# -- calibration numerics


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    """Foot points as a picture of 40-pixel squares for each frame's turn of three channels; the value is the confidence."""
    p = _pos(spark, d).filter("fx IS NOT NULL AND fy IS NOT NULL AND conf IS NOT NULL")
    return p.select(F.floor(F.col("fy") / 40).alias("py"), F.floor(F.col("fx") / 40).alias("px"), (F.col("frame") % 3).alias("channel"), F.col("conf").alias("v"))


def background_median(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vision.background(_pixels(spark, d)), "v")


def traced_line(spark: SparkSession, d: str) -> DataFrame:
    """The fullest square of each row of the picture, if it is full enough and not at the row's end."""
    counts = _pixels(spark, d).groupBy("py", "px").agg(F.count("*").cast("double").alias("v"))
    return vision.trace(counts, "py", "px")


def robust_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line through the foot points of each source (grouped numpy; no SQL form)."""
    points = _pos(spark, d).select(*WHO, F.col("fx").alias("x"), F.col("fy").alias("y"))
    return vision.robust_lines(points, WHO)


def floor_fit(spark: SparkSession, d: str) -> DataFrame:
    """Calibration from traced lines: those of each court in games, seen through the lens and rounded to pixels."""
    lines = [("x", v) for v in (0.0, 1.6, 3.2, 4.8, 6.4)] + [("y", v) for v in (0.5, 5.44, 7.04, 9.75)]
    named = spark.createDataFrame([(f"{a} = {v}", a, v) for a, v in lines], "line string, axis string, value double")
    courts = table(spark, d, "games").filter("court IS NOT NULL").select("court").distinct()
    along = named.join(courts).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(60)))).withColumn("s", F.col("i") / F.lit(60.0))  # nine lines for each court
    x, y = F.when(F.col("axis") == "x", F.col("value")).otherwise(F.col("s") * court.WIDTH), F.when(F.col("axis") == "y", F.col("value")).otherwise(F.col("s") * court.LENGTH)
    px, py = camera.to_pixels(CALIBRATION, x, y)
    traced = along.select("court", "line", "axis", "value", F.round(px).alias("px"), F.round(py).alias("py"))
    made = vision.fit_floors(traced, ["court"], (LENS.cx, LENS.cy), LENS.r0)
    return made.select("court", "line", "pixels", (F.col("rms_m") < 0.02).alias("close"), (F.abs(F.col("k") - LENS.k) < 0.01).alias("lens_found"))


def region_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows inside a four-cornered region of the court, by point-in-polygon."""
    region = [(0.5, 1.0), (6.0, 2.0), (5.0, 9.0), (1.0, 8.0)]
    return _pos(spark, d).filter(vision.in_polygon("x", "y", region)).groupBy(*WHO).agg(F.count("*").alias("n"))


def sampled_frames(spark: SparkSession, d: str) -> DataFrame:
    rows = _pos(spark, d).select(*WHO, "frame")
    return files.sampled_by_game(rows, table(spark, d, "games")).select(*WHO, "frame", "t")


def background_frames(spark: SparkSession, d: str) -> DataFrame:
    return rounded(files.sample_frames(table(spark, d, "games")), "t")


def summary_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document per clip: its record and its players'."""
    return files.summary_json(game_summary(spark, d), player_points(spark, d), CLIP)


def summary_fields(spark: SparkSession, d: str) -> DataFrame:
    """Some fields read back from the JSON documents."""
    shape = "game struct<n_rallies: bigint, longest_rally_s: double>, players array<struct<player: string, points_won: bigint>>"
    rows = summary_documents(spark, d).select(*CLIP, F.from_json("summary", shape).alias("s"))
    won = lambda p: F.get(F.filter("s.players", lambda x: x["player"] == p), F.lit(0))["points_won"]
    return rows.select(*CLIP, "s.game.n_rallies", F.round("s.game.longest_rally_s", 6).alias("longest_rally_s"), F.size("s.players").cast("bigint").alias("players"), won("p1").alias("won_p1"), won("p2").alias("won_p2"))


# -- streams, drained: each reads its table as a stream, to its end, and returns what was written


def _drain(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    base = own_folder(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", base + "/state").option("path", base + "/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(base + "/out")


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = table(spark, d, name).schema
    # as a pattern: a stream reads a folder or what a pattern finds, and the table may be a single file
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parque[t]")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_activity(spark: SparkSession, d: str) -> DataFrame:
    """Windows of event time that the watermark has closed."""
    readings = _event_stream(spark, d).select(F.format_string("u%02d", F.col("user_id") % 16).alias("game_id"), F.lit(0).alias("clip"), "ts", F.col("value").alias("speed"))
    made = _drain(live.activity(readings, "1 hour", "6 hours", "3 hours"))
    return made.select("game_id", F.col("window.start").cast("timestamp_ntz").alias("start"), F.round("activity", 6).alias("activity"), "n")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of events that the watermark has closed; an event lasts its value in seconds."""
    events = _event_stream(spark, d).select(
        F.format_string("u%05d", "user_id").alias("game_id"), F.lit(0).alias("clip"), "ts", F.floor(F.col("value")).cast("double").alias("duration"), F.col("event_type").alias("server")
    )
    made = _drain(live.serve_sessions(events, 3600.0, "1 hour"))
    return made.select("game_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "events", F.round("duration", 3).alias("duration"))


def stream_versions(spark: SparkSession, d: str) -> DataFrame:
    """Positions as a stream of versions; the newest of each key in what was written."""
    rows = of_sources(_stream(spark, d, "positions")).select(*WHO, "frame", "x", "speed", F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    return live.newest_of(_drain(live.versions(rows))).select(*WHO, "frame", "x", "speed")


def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """The running score of rallies as they come, but for the last rally of a clip, which waits for its end."""
    rows = _stream(spark, d, "rallies").select(*CLIP, "rally", "server", "box", F.timestamp_seconds("t_start").alias("ts"))
    return _drain(live.running_score(rows)).filter("NOT final").drop("final")


QUERIES = (
    p2_found, p2_flags, p2_plain, p4_found, p4_grid, p4_periods, court_zone_share, court_points, foot_point_projection, lens_undistort, lens_round_trip, homography_project, court_to_pixels, court_lines,
    activity_signal, sample_rate, frame_rate, pace_percentiles, both_players_still, gradient_speed, trail_window, hysteresis_segments, serve_events, serve_clusters, ambiguous_clusters,
    detected_rallies, segment_rallies, dropped_segments, infer_missed_serves, split_long_rallies, score_progress, rest_before, rally_interval_join, rally_path_length, player_movement,
    heatmap_bins, speed_histogram, excursion_recovery, speed_bursts, longest_streak, player_points, serve_by_box, game_summary, separation_crowding, track_reliability, rally_table,
    smoothed_heatmap, t_timeline, trajectories, comparison, gap_interpolation, savgol_track, overlay_tracks, score_asof, rally_asof, frames_near_rallies, review_topk, tracklet_labels, tracklet_stats, conflict_resolver, flip_parts,
    build_tracklets, class_membership, spectator_filter, identity_features, identity_model, patch_colours, pair_quality, frame_detections, frame_pairs, unit_vectors, separating_axis, feature_z_scores, identity_logreg, fold_sizes,
    background_median, traced_line, robust_lines, floor_fit, region_filter, sampled_frames, background_frames, summary_documents, summary_fields, stream_activity, stream_sessions, stream_versions, stream_score,
)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}
