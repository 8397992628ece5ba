"""Behaviour of the core operators on small cases, most against a plain loop."""

import json
import math
import random
from itertools import accumulate, groupby, permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyforge.functions import camera, court
from rallyforge.functions import text as text_fn
from rallyforge.operators import asof, features, identity, islands, learning, metrics, rallies, serves, signals, track, vision
from rallyforge.plans.derived import identity_tables
from rallyforge.sources import files
from rallyforge.sources.tables import clean_positions, nan_to_null


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in columns.items()))


# -- geometry


def test_zones_edges_and_boxes(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (1.0, 4.0), (5.0, 4.0), (1.0, 9.0), (5.0, 9.0), (3.2, 3.0), (0.0, 6.24), (None, 1.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = [tuple(r) for r in df.select(court.zone_row(y), court.zone_col(x), court.zone_name(x, y)).collect()]
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 2, 1, 2, 0] and [g[1] for g in got] == [0, 1, 0, 1, 0, 1, 1, 0, None]
    assert got[0][2] == "front-left" and got[5][2] == "back-right" and got[8][2] is None
    r = one(spark, x=0.5, y=6.0).select(court.in_box(x, y, "left"), court.in_box(x, y, "right"), court.box_of(x, y), court.dist_to_t(F.lit(3.2), F.lit(5.44)), court.receiver_ok(F.lit(4.0), F.lit(6.0), F.lit("left")))
    assert tuple(r.first()) == (True, False, "left", 0.0, True)
    assert spark.range(1).select(court.clip(F.lit(None).cast("double"), 0.0, 6.4), court.clip(F.lit(7.0), 0.0, 6.4)).first()[:] == (None, 6.4)


def test_camera_round_trips(spark):
    lens = camera.Lens(-0.18, 310.0, 236.0, 395.0)
    cal = camera.Calibration(((0.017, 0.001, -1.4), (-0.0005, 0.026, -3.1), (0.0001, 0.0014, 1.0)), camera.Lens(-0.12, 310.0, 236.0, 395.0))
    df = spark.createDataFrame([(90.0, 150.0), (420.0, 380.0), (310.0, 236.0), (512.0, 77.0)], "x double, y double")
    for a, b in ((lambda x, y: camera.undistort(x, y, lens), lambda x, y: camera.distort(x, y, lens)), (lambda x, y: camera.to_court(cal, x, y), lambda x, y: camera.to_pixels(cal, x, y))):
        u = df.select("x", "y", *(c.alias(n) for c, n in zip(a(F.col("x"), F.col("y")), ("u", "v"))))
        back = u.select("x", "y", *(c.alias(n) for c, n in zip(b(F.col("u"), F.col("v")), ("p", "q")))).collect()
        assert all(abs(r["x"] - r["p"]) < 1e-4 and abs(r["y"] - r["q"]) < 1e-4 for r in back)


def test_calibration_numerics():
    x = np.arange(50.0)
    y = 23 - 0.8 * x + np.where(np.arange(50) % 6 == 2, -31, 0)
    a, b, share = vision.robust_line(x, y)
    assert abs(a + 0.8) < 0.01 and abs(b - 23) < 0.5 and 0.8 < share < 0.9
    assert math.isnan(vision.robust_line(np.zeros(3), np.arange(3.0))[0])
    assert vision.edge_runs(np.array([1, 2, 3, 30, 35, 41, 60]), 6, 10) == [(30, 41)]
    assert vision.intersections([(1.0, 0.0)], [(-1.0, 2.0), (1.0, 5.0)]) == [(0, 0, 1.0, 1.0)]
    rng = np.random.default_rng(0)
    court_xy = rng.uniform(0, 6, (12, 2))
    h = np.array([[90.0, 8, 40], [3, 70, 60], [0.01, 0.02, 1]])
    p = np.c_[court_xy, np.ones(12)] @ h.T
    u = p[:, :2] / p[:, 2:]
    c, r0, k = np.array([305.0, 241.0]), 410.0, -0.16
    v = u - c
    d = v.copy()
    for _ in range(200):
        d = v * (1 + k * (d**2).sum(1) / r0**2)[:, None]
    fit, _, rms = vision.fit_lens(c + d, court_xy, tuple(c), r0)
    assert abs(fit - k) < 1e-3 and rms < 1e-3


def test_text(spark):
    df = spark.createDataFrame([(75.9, 0.256, "a", ""), (None, None, None, "b")], "s double, p double, a string, b string")
    got = df.select(text_fn.mmss(F.col("s")), text_fn.percent(F.col("p")), text_fn.number(F.col("s"), 1, " m"), text_fn.joined(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("1:15", "26 %", "75.9 m", "a"), ("–", "–", "–", "b")]


# -- islands


def frames(spark, values, t_step=0.1):
    return spark.createDataFrame([("g", 0, "p1", i, i * t_step, v) for i, v in enumerate(values)], "game_id string, clip int, player string, frame bigint, t double, v double")


def test_excursions_bursts_and_streaks_against_loops(spark):
    rng = random.Random(3)
    keys = ["game_id", "clip", "player"]
    for _ in range(3):
        v = [rng.choice([None, 0.5, 1.0, 2.0, 2.0, 2.0, 4.0]) for _ in range(80)]
        stretches = [[i for i, _ in g] for far, g in groupby(enumerate(v), key=lambda x: x[1] is not None and x[1] > 1.5) if far]
        times = [(g[-1] + 1 - g[0]) * 0.1 for g in stretches if g[-1] + 1 < len(v)]
        n = sum((g[-1] - g[0]) * 0.1 >= 0.2 - 1e-9 for g in stretches)
        df = frames(spark, v)
        r = islands.excursions(df, keys, ["frame"], F.col("v") > 1.5).first()
        assert r["n_excursions"] == len(times) and r["recovery_s"] == pytest.approx(float(np.median(times)))
        assert islands.bursts(df, keys, ["frame"], F.coalesce("v", F.lit(0.0)) > 1.5, least_s=0.2 - 1e-9).first()["bursts"] == n
    rows = spark.createDataFrame([("g", 0, i, w) for i, w in enumerate(["p1", "p1", None, "p1", "p2", "p2", "p2"])], "game_id string, clip int, rally int, winner string")
    assert {r["player"]: r["longest_run"] for r in metrics.longest_streaks(rows).collect()} == {"p1": 2, "p2": 3}
    assert islands.excursions(frames(spark, [1.0, None]), keys, ["frame"], F.col("v") > 1.5).first()["n_excursions"] == 0


def test_hysteresis_against_loop(spark):
    rng = random.Random(5)
    for _ in range(4):
        v, x = [], 1.0
        for _ in range(150):
            x = min(3.0, max(0.0, x + rng.choice([-0.6, -0.3, 0.3, 0.6])))
            v.append(round(x, 2))
        states = list(accumulate(v, lambda was, x: 1 if x > 1.8 else 0 if x < 0.9 else was, initial=0))[1:]
        spans = [[i for i, _ in g] for on, g in groupby(enumerate(states), key=lambda x: x[1]) if on]
        low = lambda i: max([k for k in range(i) if v[k] <= 0.9], default=-1) + 1
        spans = [(low(g[0]), min(g[-1] + 1, len(v) - 1)) for g in spans]
        joined = [spans[0]] if spans else []
        for a, b in spans[1:]:
            joined[-1:] = [(joined[-1][0], b)] if (a - joined[-1][1]) * 0.5 < 1.2 else [joined[-1], (a, b)]
        want = [(a * 0.5, b * 0.5) for a, b in joined if (b - a) * 0.5 >= 2.0]
        got = islands.hysteresis(frames(spark, v, 0.5), ["game_id", "clip"], ["frame"], "v", 1.8, 0.9)
        assert sorted((r["a"], r["b"]) for r in got.collect()) == want


# -- serves and score


RALLY = "game_id string, clip int, t_start double, server string, box string"


@pytest.mark.parametrize(
    "seq,winners,last",
    [
        ([("p1", "right"), ("p2", "left"), ("p2", "right"), ("p1", "left")], ["p2", "p2", "p1", None], (1, 2)),
        ([("p1", "right"), ("p1", "right"), ("p2", "left")], [None, "p2", None], (0, 1)),
        ([("p1", ["left", "right"][i % 2]) for i in range(15)], ["p1"] * 15, (15, 0)),
        ([("p1", "left"), (None, None), ("p2", "left")], [None, None, None], (0, 0)),
    ],
)
def test_score(spark, seq, winners, last):
    df = spark.createDataFrame([("g", 0, float(i), s, b) for i, (s, b) in enumerate(seq)], RALLY)
    got = serves.score(df).orderBy("t_start").collect()
    assert [r["winner"] for r in got] == winners and (got[-1]["score_p1"], got[-1]["score_p2"]) == last


def test_serve_clusters(spark):
    ev = [("p1", "left", 10.0, 10.4), ("p2", "right", 10.6, 10.8), ("p1", "left", 11.0, 12.5), ("p2", "right", 30.0, 30.6)]
    df = spark.createDataFrame([("g", 0, *e) for e in ev], "game_id string, clip int, server string, box string, t0 double, t1 double")
    got = serves.serve_clusters(df).orderBy("t0").collect()
    assert [(r["server"], r["box"], r["t0"], r["t1"], r["ambiguous"]) for r in got] == [("p1", "left", 10.0, 12.5, False), ("p2", "right", 30.0, 30.6, False)]


LIMITS = {"trough_lo": 0.8, "lull_act": 1.6, "act_play": 2.0, "min_play_act": 3.0, "relax_slow": 1.0}


def test_cutting_at_pauses():
    t = np.arange(1, 300) / 10
    act, still = np.where(t < 8, 4.0, np.where(t < 12, 0.1, 5.0)), np.zeros(len(t), bool)
    got = rallies.cuts(t, act, still, 0.0, 31.0, LIMITS)
    assert [(round(a, 1), round(b, 1)) for a, b in got] == [(0.0, 8.0), (11.9, 30.7)]
    assert rallies.cuts(t, np.full(len(t), 0.5), still, 0.0, 31.0, LIMITS) == rallies.cuts(t[:0], act[:0], still[:0], 0.0, 31.0, LIMITS) == []


def test_pauses_of_each_kind_and_what_follows_them():
    t = np.arange(1, 600) / 10
    between = lambda a, b: (t > a) & (t < b)
    act = np.full(len(t), 4.0)
    act[between(10, 15)] = 1.2  # a lull of 5 s
    act[between(20, 21)] = 0.1  # too short for a trough
    act[between(1, 3)] = 0.1  # of which too little is left 1.5 s after the start
    still = between(30, 33)
    act[t > 45] = 2.5  # play, but not strong enough to begin with
    act[between(43, 45.05)] = 0.1
    got = rallies.cuts(t, act, still, 0.5, 70.0, LIMITS)
    assert [(round(a, 1), round(b, 1)) for a, b in got] == [(0.5, 10.1), (14.9, 30.1), (32.9, 43.1)]


def test_segments_of_many_clusters(spark):
    t = np.arange(1, 300) / 10
    rows = [(g, 0, i, float(v), 4.0 if v < 8 else 0.1 if v < 12 else 5.0) for g in "ab" for i, v in enumerate(t)]
    active = spark.createDataFrame(rows, "game_id string, clip int, frame bigint, t double, activity double").withColumns({f"v{p}": F.lit(3.0) for p in "12"})
    clusters = spark.createDataFrame([("a", 0, 0.0, 0.05, "p1", "left", True), ("b", 0, 0.0, 2.0, "p2", "right", False), ("b", 0, 20.0, 21.0, "p1", "left", False)], "game_id string, clip int, t0 double, t1 double, server string, box string, ambiguous boolean")
    limits = spark.createDataFrame([(g, 0, *LIMITS.values()) for g in "ab"], "game_id string, clip int, " + ", ".join(f"{k} double" for k in LIMITS))
    ends = spark.createDataFrame([("a", 0, 31.0), ("b", 0, 29.9)], "game_id string, clip int, clip_end double")
    got = [(r["game_id"], round(r["t_start"], 2), round(r["t_end"], 2), r["server"], r["box"], r["note"]) for r in rallies.segment(active, clusters, limits, ends).orderBy("game_id", "t_start").collect()]
    assert got == [
        ("a", 0.05, 8.0, "p1", "left", "serve ambiguous"), ("a", 11.9, 30.7, None, None, "serve not detected"),
        ("b", 2.0, 8.0, "p2", "right", ""), ("b", 11.9, 19.7, None, None, "serve not detected"), ("b", 21.0, 29.6, "p1", "left", ""),
    ]
    assert rallies.segment(active.limit(0), clusters, limits, ends).count() == 0


# -- tracks


def test_interpolation_fills_the_first_rows_of_a_long_gap(spark):
    v = [None, 1.0, None, None, None, None, 6.0, None, 8.0, None]
    df = track.held(frames(spark, v).withColumn("__n", F.row_number().over(track.by_source())), "v")
    got = [r["f"] for r in df.select("frame", track.interpolate("v", F.lit(2)).alias("f")).orderBy("frame").collect()]
    assert got == [None, 1.0, 2.0, 3.0, None, None, 6.0, 7.0, 8.0, None]


def test_smoothing_against_polynomials(spark):
    rng = np.random.default_rng(0)
    n = 40
    x = 3 + np.cumsum(rng.normal(0, 0.05, n))
    rows = [("g", 0, "p1", 3 * i, 3 * i / 30, float(x[i]), 5.0, 0.9) for i in range(n) if i not in (17, 18)] + [("g", 0, "p1", 9, 9.9, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "game_id string, clip int, player string, frame bigint, t double, x double, y double, conf double")
    rates = spark.createDataFrame([("g", 0, 10.0)], "game_id string, clip int, fps_eff double")
    got = track.smooth_tracks(df, rates).orderBy("frame").toPandas()
    assert list(got.frame) == [3 * i for i in range(n)] and list(got.interpolated[got.interpolated].index) == [17, 18]
    full = x.copy()
    full[17], full[18] = x[16] + (x[19] - x[16]) / 3, x[16] + 2 * (x[19] - x[16]) / 3
    want = np.empty(n)
    for i in range(n):
        a = min(max(i - 5, 0), n - 11)
        want[i] = np.polyval(np.polyfit(np.arange(11.0), full[a : a + 11], 2), i - a)
    assert np.allclose(got.x, want, atol=1e-9) and np.allclose(got.y, 5.0)
    assert np.allclose(got.speed, np.abs(np.gradient(want)) / 0.1, atol=1e-6)


def test_gradient_is_null_beside_a_missing_neighbour(spark):
    df = frames(spark, [1.0, 2.0, None, 4.0, 8.0])
    got = [r[0] for r in df.orderBy("frame").select(signals.gradient("v", track.by_source())).collect()]
    assert got == [1.0, None, 1.0, None, 4.0]


# -- identity


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in [(1, 1), (2, 3), (3, 2), (5, 5), (4, 7), (6, 5)]:
        for _ in range(20):
            cost = np.round(rng.random((n, m)), 2)
            got = identity.assignment(cost)
            assert len(got) == min(n, m) == len({i for i, _ in got}) == len({j for _, j in got})
            small, large = (cost, m) if n <= m else (cost.T, n)
            best = min(sum(small[i, p[i]] for i in range(len(small))) for p in permutations(range(large), len(small)))
            assert sum(cost[i, j] for i, j in got) == pytest.approx(best)


def test_linking_gaps_and_crossings(spark):
    rows = [(f, 1.0 + f / 100, 1.0, 0.9, 2 * f) for f in range(0, 60, 3)] + [(f, 5.0, 8.0, 0.8, 2 * f + 1) for f in range(0, 60, 3) if f not in (30, 33)]
    df = spark.createDataFrame([("g", *r) for r in rows] + [("h", 0, None, 1.0, 0.5, 7)], "game_id string, frame bigint, x double, y double, conf double, det_id bigint")
    got = identity.build_tracklets(df, ["game_id"]).toPandas()
    assert got.groupby(got.det_id % 2).tracklet.nunique().tolist() == [1, 1] and set(got.game_id) == {"g"}
    frame = np.array([0, 0, 3, 3, 6, 6])
    cut = identity.link_clip(frame, np.array([1.0, 3.0, 1.9, 2.1, 1.0, 3.0]), np.ones(6), 3, gate=2.0)
    assert set(cut[:2]) == set(cut[2:4]) and not set(cut[4:]) & set(cut[:4])
    assert identity.link_clip(frame[:0], np.zeros(0), np.zeros(0), 3).tolist() == []


def test_matching_prefers_more_pairs_then_less_way():
    far = np.array([[0.1, 0.4], [0.2, 0.9]])
    assert sorted(identity.matching(far, np.array([[True, True], [True, False]]))) == [(0, 1), (1, 0)]
    assert sorted(identity.matching(far, np.ones((2, 2), bool))) == [(0, 1), (1, 0)]
    assert identity.matching(far, np.zeros((2, 2), bool)) == [] and identity.matching(np.zeros((0, 2)), np.zeros((0, 2), bool)) == []


def test_flips_keep_the_last_rows(spark):
    s = [0.9] * 12 + [-0.9] * 12
    df = spark.createDataFrame([("g", 1, i, float(v), 0.9) for i, v in enumerate(s)], "game_id string, tracklet bigint, frame bigint, score double, conf double")
    got = [r["part"] for r in identity.split_on_flips(df, ["game_id"], margin=0.1).orderBy("frame").collect()]
    assert got[:12] == [0] * 12 and got[19:] == [0] * 5 and set(got[13:19]) == {1}


def test_frame_conflicts(spark):
    rows = [(0, 1, "p1", 5.0, 0.9), (0, 2, "p1", 3.0, 0.5), (0, 3, "p1", 1.0, 0.1), (1, 1, "p1", 5.0, 0.9), (1, 2, "p1", 3.0, 0.9), (2, 1, "p1", 5.0, 0.1), (2, 2, "p1", 3.0, 0.1), (2, 3, "p2", 1.0, -0.1)]
    df = spark.createDataFrame([("g", *r) for r in rows], "game_id string, frame bigint, det_id bigint, label string, weight double, score double")
    got = [r["player"] for r in identity.resolve_frames(df, ["game_id"]).orderBy("frame", "det_id").collect()]
    assert got == ["p1", "p2", None, "p1", None, "p1", None, "p2"]


def test_labels_and_classes(spark):
    df = spark.createDataFrame([("g", 1, 0, None, 0.5), ("g", 2, 0, 0.4, 0.5), ("g", 2, 3, 0.2, 0.7)], "game_id string, tracklet bigint, frame bigint, score double, conf double")
    got = {r["tracklet"]: r for r in identity.tracklet_labels(df, ["game_id"]).collect()}
    assert got[1]["label"] == "p2" and got[1]["weight"] == 0 and got[2]["label"] == "p1" and got[2]["n"] == 2
    labels = spark.createDataFrame([("g", 1, "P1 "), ("g", 1, "p2"), ("g", 2, None), ("g", 3, "other"), ("g", 3, "P2")], "game_id string, tracklet bigint, label string")
    assert {r["tracklet"]: r["class"] for r in identity.class_of(labels, ["game_id"]).collect()} == {1: 1, 2: -1, 3: 0}


# -- lookups, vectors, model


def test_asof_boundaries(spark):
    f = spark.createDataFrame([("g", 0, i, float(i)) for i in range(6)], "game_id string, clip int, frame bigint, t double")
    r = spark.createDataFrame([("g", 0, 1, 1.0, 2.0, 1, 0), ("g", 0, 2, 2.0, 4.0, 1, 1)], "game_id string, clip int, rally int, t_start double, t_end double, score_p1 int, score_p2 int")
    assert [(x["score_p1"], x["score_p2"]) for x in asof.score_at(f, r).orderBy("t").collect()] == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 1), (1, 1)]
    assert [x["rally"] for x in asof.rally_at(f, r).orderBy("t").collect()] == [None, 1, 1, 2, 2, None]
    assert asof.near_rallies(f, r, 0.5).count() == 4


def test_axis_and_two_means(spark):
    rng = np.random.default_rng(0)
    axis = np.array([3.0, 4.0]) / 5
    rows = [(i, [float(v) for v in axis * (1 if i % 2 else -1) + rng.normal(0, 0.05, 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("grp", F.floor(F.col("vec_id") / 2))
    got = features.separating_axis(features.frame_pairs(df, ["grp"], "vec_id", "embedding"), 2)
    assert abs(abs(got @ axis) - 1) < 1e-3
    scored = features.axis_scores(df, "embedding", got)
    assert features.pair_quality(scored, ["grp"]).first()["opposite_share"] == 1.0
    assert features.frame_pairs(df.filter("vec_id <> 1"), ["grp"], "vec_id", "embedding").count() == 99
    hsv = np.stack([np.full((8, 8), 30.0), np.full((8, 8), 255.0), np.full((8, 8), 10.0)], axis=-1)
    d = features.hsv_descriptor(hsv)
    assert len(d) == 28 and d[2] == pytest.approx(1) and features.hsv_descriptor(hsv[:3]) is None


def test_identity_model_and_folds(spark):
    rng = np.random.default_rng(0)
    rows = [(i // 5, float(i // 5 % 2), [float(v) for v in rng.normal([i // 5 % 2 * 2.0, 0.0], 0.4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "tracklet bigint, label double, v array<double>").withColumn("features", learning.to_vector("v"))
    folds = learning.group_folds(df, ["tracklet"])
    assert folds.count() == 60 and folds.groupBy("fold").count().agg(F.max("count")).first()[0] <= 20
    r = learning.accuracy(learning.cross_validate(df, ["tracklet"]), ["tracklet"]).first()
    assert r["rows"] == 300 and r["groups"] == 60 and r["row_accuracy"] > 0.95 and r["group_accuracy"] > 0.98


def test_fits_and_joins_by_detection_do_not_shuffle_wide_rows(spark, positions_of):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = [(i // 5, float(i // 5 % 2), [float(i % 7), float(i % 5)]) for i in range(100)]
    df = spark.createDataFrame(rows, "tracklet bigint, label double, v array<double>").withColumn("features", learning.to_vector("v"))
    assert "Exchange hashpartitioning" not in plan(learning.cross_validate(df, ["tracklet"], folds=2))
    pos = positions_of([dict(frame=i, player=p) for i in range(50) for p in ("p1", "p2")])
    made, apart = identity_tables(pos, in_place=True), identity_tables(pos)
    tables = ("detections", "patches", "appearance", "cnn")
    joined, _, _ = features.feature_table(*(made[n] for n in tables), ["game_id", "clip", "det_id"], n_c=4)
    want, _, _ = features.feature_table(*(apart[n] for n in tables), ["game_id", "clip", "det_id"], n_c=4)
    assert plan(joined).count("REPARTITION_BY_COL") == plan(joined).count("Exchange hashpartitioning") == 4
    assert joined.exceptAll(want).count() == 0 and joined.count() == 100


# -- files and cleaning


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("g", 1.23456, None, ""), ("h", 2.0, 3.0, "x")], "game_id string, a double, b double, s string")
    files.write_csv(df, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), df.schema).orderBy("game_id").collect()
    assert [tuple(r) for r in got] == [("g", 1.2346, None, None), ("h", 2.0, 3.0, "x")]
    files.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and (tmp_path / "p" / "game_id=g").exists()
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "game_id string, a double").count() == 2
    calls = []
    for _ in range(2):
        assert files.stage(spark, str(tmp_path / "s"), lambda: calls.append(1) or df).count() == 2
    assert len(calls) == 1
    doc = files.summary_json(df.select("game_id", "a"), df.select("game_id", F.lit("p1").alias("player"), "b"), ["game_id"]).orderBy("game_id").first()
    assert json.loads(doc["summary"])["game"] == {"a": 1.23456}


def test_configuration(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("camera: low\nframe_stride: 3\n")
    (tmp_path / "g.yaml").write_text("court: c.yaml\nframe_stride: 1\nvideo: v.mp4\n")
    monkeypatch.setenv("RALLYFORGE_CONFIG", str(tmp_path / "g.yaml"))
    got = files.load_config()
    assert got["camera"] == "low" and got["frame_stride"] == 1 and got["video"] == str(tmp_path / "v.mp4")


def test_cleaning(spark, positions_of):
    rows = [dict(frame=1, x=float("nan")), dict(frame=2, speed=math.inf), dict(frame=2, speed=math.inf), dict(frame=3, player="")]
    got = clean_positions(positions_of(rows)).orderBy("frame").collect()
    assert [(r["frame"], r["x"], r["speed"]) for r in got] == [(1, None, 1.0), (2, 3.0, None)]
    assert nan_to_null(positions_of(rows)).filter("isnan(x)").count() == 0
    assert clean_positions(positions_of([])).count() == 0


def test_polygon(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (0.5, 1.9), (None, 1.0)], "x double, y double")
    assert [r[0] for r in df.select(F.coalesce(vision.in_polygon("x", "y", [(0, 0), (2, 0), (2, 2), (0, 2)]), F.lit(False))).collect()] == [True, False, True, False]


def test_running_score_stream(spark, tmp_path):
    from rallyforge.streaming import live

    rows = [("g", 0, i, s, b) for i, (s, b) in enumerate([("p1", "right"), ("p2", "left"), ("p2", "right"), ("p1", "left")])]
    df = spark.createDataFrame(rows, "game_id string, clip int, rally int, server string, box string")
    for k, part in enumerate((df.filter("rally < 2"), df.filter("rally >= 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = live.running_score(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet")
        q.option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("rally").collect()
    assert [(r["rally"], r["score_p1"], r["score_p2"]) for r in got] == [(0, 0, 1), (1, 0, 2), (2, 1, 2)]


def test_folds_are_those_of_dealing_group_by_group():
    rng = np.random.default_rng(0)
    for sizes in (rng.integers(1, 30, 200).tolist(), [1000] + [1] * 700, [5], [7] * 12, rng.integers(1, 4, 50).tolist() + [500, 400]):
        loads, counts = [0] * 5, {}
        for n in sorted(sizes, reverse=True):
            loads[loads.index(min(loads))] += n
            counts[n] = counts.get(n, 0) + 1
        dealt = learning.deal(counts)
        got = [sum(n * (upto[k] - (upto[k - 1] if k else 0)) for n, upto in dealt) for k in range(5)]
        assert got == loads and all(upto[-1] == counts[n] for n, upto in dealt)


def test_lets_are_counted_by_one_predicate_and_listed_by_another(spark):
    cols = "game_id string, clip int, rally int, t_start double, t_end double, duration double, server string, box string, winner string, score_p1 int, score_p2 int, note string, rest_before double"
    rows = [("g", 0, i, float(i), i + 0.5, 0.5, "p1", "left", w, 0, 0, note, None) for i, (w, note) in enumerate([("p1", None), (None, "let"), (None, serves.LET), (None, "outlet"), ("p2", serves.LET)])]
    got = metrics.game_summary(spark.createDataFrame(rows, cols)).first()
    assert (got["n_lets"], got["n_unknown"], got["n_points"]) == (2, 2, 2)


def test_review_by_user_and_from_both_sides(spark):
    cols = "game_id string, clip int, rally int, duration double, winner string, note string, dist_p1 double, dist_p2 double, tshare_p1 double, tshare_p2 double"
    #        rally, duration, winner, note, ways, shares
    rows = [
        (1, 9.0, "p1", None, 5.0, 90.0, 0.9, 0.1), (2, 30.0, "p1", "let", 6.0, 20.0, 0.5, 0.2), (3, 5.0, "p2", None, 50.0, 7.0, 0.1, 0.8),
        (4, 6.0, "p2", None, 40.0, 8.0, 0.2, 0.9), (5, 7.0, "p2", None, 30.0, 9.0, 0.3, 0.4), (6, 8.0, "p1", None, None, 95.0, None, 0.3), (7, 1.0, None, "a let", 1.0, 1.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame([(g, 0, *r) for g in ("mine", "both", "p2s") for r in rows], cols)
    users = spark.createDataFrame([("mine", "p1"), ("both", None), ("p2s", "p2")], "game_id string, user_player string")
    got = {g: {r["rally"]: (r["reason"], r["player"]) for r in asof.review(df, users).collect() if r["game_id"] == g} for g in ("mine", "both", "p2s")}
    lost, won, ran = asof.LOST_RUNNING, asof.WON_AT_T, asof.MADE_TO_RUN
    assert got["mine"] == {1: (won, "p1"), 2: (asof.LONGEST, None), 3: (lost, "p1"), 4: (lost, "p1"), 6: (ran, "p1"), 7: (asof.LET, None)}
    assert got["both"] == {1: (won, "p1"), 2: (asof.LONGEST, None), 3: (lost, "p1"), 4: (lost, "p1"), 6: (lost, "p2"), 7: (asof.LET, None)}
    assert got["p2s"] == {1: (lost, "p2"), 2: (asof.LONGEST, None), 3: (won, "p2"), 4: (won, "p2"), 6: (lost, "p2"), 7: (asof.LET, None)}


def test_handedness_and_rate_of_frames(spark):
    rows = [("g", 0, p, i, float(i), 1, x, 5.0, 1.0, 1.0, x, 5.0, 1.0) for p in ("p1", "p2") for i, x in enumerate([1.0, 1.5, 5.0, 2.0])]
    df = spark.createDataFrame(rows, "game_id string, clip int, player string, frame bigint, t double, rally int, x double, y double, speed double, dist_t double, ox double, oy double, od double")
    got = {r["player"]: r["forehand_side_share"] for r in metrics.movement(df, left_handed=("p2",)).collect()}
    assert got == {"p1": 0.25, "p2": 0.75}
    timed = spark.createDataFrame([("g", 0, i, i / 30, 3) for i in range(0, 30, 3)] + [("g", 0, 5, 0.0, 3)], "game_id string, clip int, frame bigint, t double, stride int")
    assert signals.rate_of_frames(timed).first()["fps_eff"] == pytest.approx(10.0)


# -- colours of pictures


def test_colours_of_regions_and_bodies():
    picture = np.zeros((40, 20, 3), np.uint8)
    picture[:20] = (30, 100, 200)
    picture[20:] = (90, 60, 50)
    sure, unsure = np.array([[8.0, 10.0, 0.9], [12.0, 10.0, 0.9]]), np.array([[8.0, 10.0, 0.1], [12.0, 10.0, 0.2]])
    hips, knees = np.array([[9.0, 20.0, 0.9], [11.0, 20.0, 0.9]]), np.array([[9.0, 32.0, 0.8], [11.0, 32.0, 0.1]])
    box = (0.0, 0.0, 20.0, 40.0)
    assert features.shorts_colour(picture, box, hips, knees) == [90, 60, 50]
    assert features.shorts_colour(picture, (0.0, 0.0, 20.0, 30.0), hips * [1, 1, 0.1], knees) == [30, 100, 200]  # rows 13 to 20 of the box
    assert all(math.isnan(v) for v in features.shorts_colour(picture, (0.0, 0.0, 3.0, 3.0), unsure, unsure))
    d = features.descriptor(picture, box, sure, hips, knees)
    assert len(d) == 31 and d[28:] == [200, 60, 50] and sum(d[:12]) == pytest.approx(1) and sum(d[12:20]) == pytest.approx(1)
    assert d[2] == pytest.approx(10 * 100 / (10 * 100 + 12 * 60)) and features.descriptor(picture, (0.0, 0.0, 3.0, 40.0), sure, hips, knees) is None
    whole = features.descriptor(picture, box, unsure, unsure, unsure)  # 20 % to 70 % of the box, its middle as the waist
    assert whole[28:] == pytest.approx([np.mean([200] * 10), 60 * 8 / 10 + 100 * 2 / 10, 50 * 8 / 10 + 200 * 2 / 10])
    assert features.patch_colour(picture, 10, 5, 2) == [30, 100, 200] and all(math.isnan(v) for v in features.patch_colour(picture, 30, 5, 2))


def test_feature_table_keeps_every_detection(spark):
    key = ["game_id", "det_id"]
    det = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1)], "game_id string, det_id bigint")
    patches = spark.createDataFrame([("g", 1, 1.0, 2.0, 3.0, None, 4.0, 5.0, 6.0, 7.0, 9.0)], "game_id string, det_id bigint, chest_h double, chest_s double, chest_v double, lth_h double, rth_h double, lth_s double, rth_s double, lth_v double, rth_v double")
    app = spark.createDataFrame([("h", 1, [0.5, 0.25], 1.0, 2.0, 3.0)], "game_id string, det_id bigint, d array<double>, shirt_v double, shorts_s double, shorts_v double")
    cnn = spark.createDataFrame([("g", 2, [0.1, 0.2])], "game_id string, det_id bigint, embedding array<double>")
    made, by_hand, learned = features.feature_table(det, patches, app, cnn, key, 2, 2)
    got = {(r["game_id"], r["det_id"]): r for r in made.collect()}
    assert len(got) == 3 and got["g", 1]["th_h"] == 4.0 and got["g", 1]["th_s"] == 5.5 and got["h", 1]["d1"] == 0.25 and got["g", 2]["c0"] == 0.1 and got["h", 1]["c0"] is None
    scored = {(r["game_id"], r["det_id"]): r for r in features.z_scores(made, by_hand + learned, tuple(by_hand), ("game_id",)).collect()}
    assert scored["g", 2]["th_s"] == pytest.approx(0) and scored["h", 1]["d0"] is None  # the deviation of one row is not known
