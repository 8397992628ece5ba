import datetime as dt
import math

import numpy as np
import pytest

from rallyforge.operators import regular_grid as rg

NAN = float("nan")


def grid(positions_of, rows, **kw):
    return sorted(rg.regular_grid(positions_of(rows), **kw).collect(), key=lambda r: (r["player"], r["period_no"]))


def test_periods_from_first_to_last_reading(spark, positions_of):
    rows = [dict(frame=i, t=t, x=3.0, y=5.0) for i, t in enumerate([0.1, 0.6, 2.2, 2.4, 4.9])]
    out = grid(positions_of, rows)
    assert [r["period_no"] for r in out] == list(range(10))
    assert [r["period_no"] for r in out if r["missing"]] == [2, 3, 5, 6, 7, 8]
    assert all(r["missing"] == r["interpolated"] for r in out) and [r["n_readings"] for r in out][4] == 2
    assert all(abs(r["x"] - 3) < 0.05 and abs(r["y"] - 5) < 0.05 for r in out)
    assert out[6]["sd"] > out[4]["sd"]


def test_what_is_a_reading(spark, positions_of):
    day = dt.datetime(2025, 1, 2)
    rows = [
        dict(frame=0, t=0.0), dict(frame=1, t=0.5, interpolated=True), dict(frame=2, t=1.0, x=None), dict(frame=3, t=1.5, y=NAN), dict(frame=4, t=2.0, interpolated=None),
        dict(frame=5, t=None), dict(frame=6, t=math.inf), dict(frame=7, t=2.5), dict(frame=7, t=2.5, x=None, ingested_at=day), dict(frame=8, t=3.0, x=math.inf), dict(frame=9, t=3.5),
    ]
    out = grid(positions_of, rows)
    assert [r["period_no"] for r in out if r["missing"]] == [1, 2, 3, 5]
    assert all(r["x"] is not None and math.isfinite(r["x"]) for r in out)


def test_empty_single_and_without_source(spark, positions_of):
    assert grid(positions_of, []) == []
    assert grid(positions_of, [dict(frame=1, player=""), dict(frame=2, player=None)]) == []
    assert [(r["period_no"], r["missing"]) for r in grid(positions_of, [dict(frame=1, t=-0.2)])] == [(-1, False)]


@pytest.mark.parametrize("block", [4, 24, 64])
def test_blocks_of_a_long_source_do_not_change_its_periods(spark, positions_of, block):
    rng = np.random.default_rng(3)
    t = np.sort(np.round(rng.uniform(-9, 60, 160), 3))
    t = t[(t < 20) | (t > 33)]
    rows = [dict(frame=i, t=float(v), x=3 + math.sin(v / 3), y=5.0 + (5.0 if i == 40 else 0.0)) for i, v in enumerate(t)]
    whole, cut = grid(positions_of, rows), grid(positions_of, rows, block_periods=block, halo_periods=24, chunk_frames=16)
    plain = [(r["period_no"], r["missing"], r["n_readings"]) for r in whole]
    assert plain == [(r["period_no"], r["missing"], r["n_readings"]) for r in cut] and sum(r["missing"] for r in whole) > 20
    if block >= 24:  # a block sees no further than the next one, so tiny ones forget what they should not
        assert all(abs(a["x"] - b["x"]) < 0.05 * a["sd"] + 0.01 and abs(a["sd"] - b["sd"]) < 0.05 * a["sd"] + 0.01 for a, b in zip(whole, cut))


def test_a_bridge_equals_the_smoother_at_times_without_a_reading():
    rng = np.random.default_rng(2)
    sizes = [40, 9, 1]
    gid = np.repeat(np.arange(3), sizes)
    t = np.concatenate([np.sort(rng.uniform(0, 20, n)) for n in sizes])
    xy = np.cumsum(rng.normal(0, 0.05, (len(t), 2)), 0)
    noise = np.array([0.02, 0.05, 0.03])
    trend = rg.Trend(t, xy, gid, 3, noise)
    extra = np.concatenate([np.sort(rng.uniform(t[gid == g].min(), t[gid == g].max() + 2, 15)) for g in range(3)])
    owner = np.repeat(np.arange(3), 15)
    x, y, variance = rg.bridge(trend.ends(owner, extra).T, extra)
    times, groups, seen = np.r_[t, extra], np.r_[gid, owner], np.r_[np.ones(len(t), bool), np.zeros(45, bool)]
    order = np.lexsort((times, groups))
    start = np.r_[0, np.cumsum(np.bincount(groups))]
    place, var = rg.smooth(times[order], np.r_[xy, np.zeros((45, 2))][order], seen[order], noise, start)
    back = np.argsort(order)[len(t) :]
    assert np.allclose(np.c_[x, y], place[back], atol=1e-6) and np.allclose(variance, var[back], rtol=1e-4, atol=1e-9)


def test_a_clock_that_jumps(spark, positions_of):
    rows = [dict(frame=i, t=i / 10) for i in range(20)] + [dict(frame=20 + i, t=2e6 + i / 10) for i in range(5)]
    out = rg.regular_grid(positions_of(rows))
    holes = out.filter("missing")
    assert holes.count() == holes.select("period_no").distinct().count() == 4_000_000 - 4
    low, high, known = holes.selectExpr("min(period_no)", "max(period_no)", "count(x)").first()
    assert (low, high, known) == (4, 3_999_999, 4_000_000 - 4)


def test_only_infinite_places(spark, positions_of):
    out = grid(positions_of, [dict(frame=0, t=0.0, x=math.inf), dict(frame=1, t=1.2, x=math.inf)])
    assert [(r["period_no"], r["missing"], r["x"], r["sd"]) for r in out] == [(0, False, None, None), (1, True, None, None), (2, False, None, None)]
    out = grid(positions_of, [dict(frame=0, t=0.0), dict(frame=1, t=0.2), dict(frame=2, t=1.2, x=math.inf), dict(frame=3, t=3.2, y=-math.inf)])
    assert [r["missing"] for r in out] == [False, True, False, True, True, True, False] and all(abs(r["x"] - 3) < 0.1 for r in out) and out[5]["sd"] > out[1]["sd"]
    out = grid(positions_of, [dict(frame=0, t=0.0), dict(frame=1, t=0.1, x=1e200), dict(frame=2, t=1.2)])
    assert all(abs(r["x"] - 3) < 0.1 for r in out)


def test_smoother_equals_batch_least_squares():
    rng = np.random.default_rng(1)
    sizes = [20, 7, 1, 33]
    start = np.r_[0, np.cumsum(sizes)]
    t = np.concatenate([np.sort(rng.uniform(0, 10, n)) for n in sizes])
    xy = np.cumsum(rng.normal(0, 0.05, (len(t), 2)), 0)
    seen = rng.random(len(t)) < 0.7
    seen[start[:-1]] = True
    noise = np.array([0.02, 0.05, 0.03, 0.04])
    place, variance = rg.smooth(t, xy, seen, noise, start)
    for g, (a, b) in enumerate(zip(start[:-1], start[1:])):
        n = b - a
        h, right = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
        h[:2, :2] += np.linalg.inv(np.diag([1e4, 25.0]))
        for i in range(n - 1):
            d = t[a + i + 1] - t[a + i]
            q = rg.INTENSITY * np.array([[d**3 / 3, d * d / 2], [d * d / 2, d]])
            j = np.hstack([-np.array([[1, d], [0, 1]]), np.eye(2)])
            h[2 * i : 2 * i + 4, 2 * i : 2 * i + 4] += j.T @ np.linalg.inv(q) @ j
        for i in np.flatnonzero(seen[a:b]):
            h[2 * i, 2 * i] += noise[g] ** -2
            right[2 * i] += xy[a + i, 0] * noise[g] ** -2
        cov = np.linalg.inv(h)
        assert np.allclose((cov @ right)[::2], place[a:b, 0], atol=1e-6)
        assert np.allclose(np.diag(cov)[::2], variance[a:b], rtol=1e-4)
