import datetime as dt
import math

import numpy as np
import pytest

from rallyforge.operators import spikes

NAN = float("nan")


def faults(spark, positions_of, games_of, rows, **kw):
    out = spikes.flag_faults(positions_of(rows), games_of(), **kw).collect()
    return {(r["player"], r["frame"]): (r["x_fault"], r["y_fault"], r["speed_fault"]) for r in out}


def walk(n=200, seed=0, player="p1", first=0):
    rng = np.random.default_rng(seed)
    x = 3 + np.cumsum(rng.normal(0, 0.02, n)).clip(-2, 2)
    y = 5 + np.cumsum(rng.normal(0, 0.03, n)).clip(-3, 3)
    return [dict(player=player, frame=first + i, x=round(float(x[i]), 4), y=round(float(y[i]), 4), speed=round(float(0.3 + 0.2 * rng.random()), 4)) for i in range(n)]


def test_quiet_source_has_no_fault(spark, positions_of, games_of):
    assert faults(spark, positions_of, games_of, walk()) == {}


def test_each_kind(spark, positions_of, games_of):
    rows = walk()
    rows[20]["x"] = 7.0
    rows[30]["y"] = math.inf
    rows[40]["speed"] = -0.1
    rows[50]["speed"] = math.inf
    rows[60]["speed"] = 9.0
    for i in (80, 81):
        rows[i]["y"] = round(rows[i]["y"] - 1.5, 4)
    for i in range(100, 108):
        rows[i]["x"] = 2.5
    for i in range(120, 127):
        rows[i]["speed"] = 0.4  # seven rows are no stuck series
    found = faults(spark, positions_of, games_of, rows)
    assert {f for _, f in found} == {20, 30, 40, 50, 60, 80, 81, *range(100, 108)}
    assert found["p1", 20][0] == found["p1", 30][1] == found["p1", 40][2] == found["p1", 50][2] == "range"
    assert found["p1", 60][2] == found["p1", 80][1] == "spike" and found["p1", 103][0] == "stuck"


def test_edges_of_the_court_and_missing_values_are_no_faults(spark, positions_of, games_of):
    rows = walk(60)
    rows[10].update(x=None), rows[11].update(x=NAN), rows[12].update(speed=None)
    rows += [dict(player="p2", frame=i, x=[0.0, 6.4][i % 2], y=[0.0, 9.75][i % 2], speed=0.1 + i / 100) for i in range(40)]
    assert faults(spark, positions_of, games_of, rows) == {}


def test_first_row_after_missing_rows_may_lie_far(spark, positions_of, games_of):
    rows = walk(100)
    far = [{**r, "x": r["x"] + 2} for r in rows[60:]]
    assert faults(spark, positions_of, games_of, rows[:50] + far) == {}


def test_usual_for_one_source_is_faulty_in_another(spark, positions_of, games_of):
    fast = [dict(player="p2", frame=i, x=3 + (i % 7) / 50, y=5 + (i % 5) / 50, speed=5.0 + (i % 11) / 3) for i in range(100)]
    slow = walk(100)
    slow[40]["speed"] = 6.0
    assert set(faults(spark, positions_of, games_of, fast + slow)) == {("p1", 40)}


def test_only_the_newest_version_counts(spark, positions_of, games_of):
    rows = walk(50)
    old = {**rows[10], "x": 9.0}
    new = {**rows[11], "x": 9.0, "ingested_at": dt.datetime(2025, 1, 2)}
    found = faults(spark, positions_of, games_of, [{**old, "ingested_at": dt.datetime(2024, 1, 1)}, new, *rows, rows[5]])
    assert set(found) == {("p1", 11)}


def test_no_source_and_empty(spark, positions_of, games_of):
    rows = [{**r, "player": p, "x": 9.0} for r, p in zip(walk(4), ["", None, "", None])]
    assert faults(spark, positions_of, games_of, rows) == {}
    assert faults(spark, positions_of, games_of, []) == {}


@pytest.mark.parametrize("chunk", [4, 6, 600])
def test_chunks_do_not_change_a_flag(spark, positions_of, games_of, chunk):
    rng = np.random.default_rng(5)
    rows = walk(300) + walk(260, seed=2, player="p2", first=37)
    for r, v in zip(rows, rng.uniform(0.1, 4.0, 560)):
        r["speed"] = round(float(v), 4)
    for i in (*range(60, 70), *range(92, 110), *range(300, 480)):
        rows[i]["x"] = 2.0  # two series over chunk ends, and one over whole chunks
    rows[200]["y"] = round(rows[200]["y"] + 2, 4)
    rows[128]["y"] = round(rows[128]["y"] - 2, 4)
    rows[150]["speed"] = 30.0
    rows[210]["speed"], rows[240]["x"], rows[530]["y"] = -1.0, 9.0, None
    del rows[20:29]
    whole = faults(spark, positions_of, games_of, rows)
    found = faults(spark, positions_of, games_of, rows, chunk_profiles=chunk)
    assert found == whole and {k for k, f in found.items() if f[2] == "spike"} == {("p1", 150)}
    assert {f for (p, f), kinds in found.items() if p == "p1" and kinds[1] == "spike"} == {128, 200}
    assert sum(kinds[0] == "stuck" for kinds in found.values()) == 10 + 18 + 180


def test_robust_components_ignore_a_huge_spike():
    v = np.sin(np.arange(80) / 5) * 0.1
    v[33] += 400
    grids = [spikes.Profiles(v, np.zeros(80, np.int64), np.arange(80), offset, 1) for offset in (0, spikes.PROFILE // 2)]
    gram = sum(p.gram(np.ones(len(p.gid), bool)) for p in grids)
    off = spikes.rests(grids, spikes.components(gram, np.array([5.0])))
    assert abs(off[33] - 400) < 1 and np.abs(np.delete(off, 33)).max() < 0.1


def test_a_source_is_judged_whole(spark, positions_of, games_of):
    rows = walk(400, first=1_000)
    for r, v in zip(rows, np.random.default_rng(3).uniform(0.2, 5.0, 400)):
        r["speed"] = round(float(v), 4)
    quiet = walk(200, seed=1, first=30_000)  # beyond frame 16,384, where chunks used to end
    quiet[100]["speed"] = 5.0  # as fast as the source was before
    assert not [k for k, f in faults(spark, positions_of, games_of, rows + quiet).items() if f[2]]


def test_a_constant_series_over_a_long_hole(spark, positions_of, games_of):
    rows = [{**r, "frame": r["frame"] + (0 if i < 100 else 3_000)} for i, r in enumerate(walk(200, first=16_280))]
    for i in range(95, 105):
        rows[i]["x"] = 2.0
    found = faults(spark, positions_of, games_of, rows)
    assert [r["frame"] for r in rows[95:105]] == sorted(f for (_, f), kinds in found.items() if kinds[0] == "stuck")
