import datetime as dt
import math
import random

import pytest

from rallyforge.llm import runs

NAN = float("nan")


def found(positions_of, games_of, rows, **kw):
    games = kw.pop("games", games_of())
    return sorted((r["player"], r["frame_first"], r["frame_last"], r["n_rows"], r["duration"]) for r in runs.collapse_runs(positions_of(rows), games, **kw).collect())


def test_runs_durations_and_limits(spark, positions_of, games_of):
    speed = [1.0, 1.02, 1.0, 1.0201, 2.0, 2.0]
    rows = [dict(frame=i, speed=s) for i, s in enumerate(speed)] + [dict(frame=9, speed=2.0), dict(frame=12, speed=2.0)]
    out = found(positions_of, games_of, rows)
    assert out == [("p1", 0, 2, 3, 0.2), ("p1", 3, 3, 1, 0.0), ("p1", 4, 5, 2, 0.1), ("p1", 9, 12, 2, 0.3)]
    assert found(positions_of, games_of, rows, least_rows=3) == [("p1", 0, 2, 3, 0.2)]


def test_missing_infinite_and_strides(spark, positions_of, games_of):
    rows = [dict(frame=3 * i, speed=v, dist_t=d, t=t) for i, (v, d, t) in enumerate([(1.0, 1.0, None), (1.0, 1.0, NAN), (NAN, 1.0, 1.0), (1.0, None, 2.0), (math.inf, 1.0, 3.0), (math.inf, 1.0, 4.0)])]
    out = found(positions_of, games_of, rows, games=games_of(("g", 3)))
    assert [(a, b, n) for _, a, b, n, _ in out] == [(0, 3, 2), (6, 6, 1), (9, 9, 1), (12, 12, 1), (15, 15, 1)] and out[0][4] is None


def test_versions_copies_and_no_source(spark, positions_of, games_of):
    new = dt.datetime(2025, 1, 2)
    rows = [dict(frame=i) for i in range(4)] + [dict(frame=1, speed=5.0, ingested_at=new), dict(frame=2), dict(frame=3, player=""), dict(frame=4, player=None), dict(frame=None)]
    random.Random(0).shuffle(rows)
    assert [x[1:4] for x in found(positions_of, games_of, rows)] == [(0, 0, 1), (1, 1, 1), (2, 3, 2)]
    assert found(positions_of, games_of, []) == []


@pytest.mark.parametrize("chunk", [5, 16, 1000])
def test_against_plain_loop_over_chunks(spark, positions_of, games_of, chunk):
    rng = random.Random(7)
    frames = sorted(rng.sample(range(200), 150))
    rows = [dict(frame=f, speed=round(rng.choice([1.0, 1.01, 1.02, 1.05]), 4), player=rng.choice(["p1", "p2"])) for f in frames]
    want = []
    for p in ("p1", "p2"):
        open_ = []
        for r in [r for r in rows if r["player"] == p]:
            if open_ and abs(round(r["speed"] * 1e4) - round(open_[-1]["speed"] * 1e4)) <= 200 and r["frame"] - open_[-1]["frame"] <= 3:
                open_.append(r)
            else:
                if open_:
                    want.append((p, open_[0]["frame"], open_[-1]["frame"], len(open_)))
                open_ = [r]
        want.append((p, open_[0]["frame"], open_[-1]["frame"], len(open_)))
    assert [x[:4] for x in found(positions_of, games_of, rows, chunk_frames=chunk)] == sorted(want)


def test_most_similar_neighbours_merge_first():
    import numpy as np

    assert runs.agglomerate(np.array([5, -1, 0, 3]), 5).tolist() == [0, 2]
    assert runs.agglomerate(np.array([], np.int64), 1).tolist() == [0]


def test_very_large_values(spark, positions_of, games_of):
    rows = [dict(frame=i, speed=v) for i, v in enumerate([1e14, 1e14, 1e14 + 0.5, 1e200, 1e200, 2e200, -1e308, 1e308])]
    for chunk in (3, 1000):
        assert [x[1:4] for x in found(positions_of, games_of, rows, chunk_frames=chunk)] == [(0, 1, 2), (2, 2, 1), (3, 4, 2), (5, 5, 1), (6, 6, 1), (7, 7, 1)]
