import datetime as dt
import math
import random

import numpy as np
import pytest

from rallyforge.llm import percentiles as pc
from rallyforge.llm import queries

INF, NAN = math.inf, math.nan


def rank_value(v, q):
    v = sorted(v)
    return v[max(1, math.ceil(q * len(v))) - 1]


@pytest.mark.parametrize("finish", [20_000, 5, 1])
def test_exact_by_rank(spark, positions_of, finish):
    rng = random.Random(0)
    rows = [dict(game_id=rng.choice("ab"), player=rng.choice(["p1", "p2"]), clip=i % 3, frame=i, speed=rng.choice([0.5, round(rng.random(), 2), NAN, None, INF, -INF]), dist_t=rng.random()) for i in range(600)]
    rows += [dict(game_id="c", frame=1, speed=7.0, dist_t=None), dict(game_id="c", frame=1, speed=8.0, dist_t=NAN, ingested_at=dt.datetime(2026, 1, 1))]
    out = pc.percentiles(positions_of(rows), finish=finish).collect()
    kept = rows[:-2] + [rows[-1]]
    for r in out:
        of = [x for x in kept if x.get("player", "p1") == r["player"]]
        if r["level"] == "game_player":
            of = [x for x in of if x["game_id"] == r["game_id"]]
        v = [x[r["metric"]] for x in of if x[r["metric"]] is not None and not math.isnan(x[r["metric"]])]
        assert r["n"] == len(v) and r["rank_error"] == 0
        assert r["value"] == (rank_value(v, r["q"]) if v else None), r
    assert {(r["level"], r["game_id"], r["player"]) for r in out} >= {("player", None, "p1"), ("game_player", "c", "p1")}
    assert len(out) == len({(r["level"], r["game_id"], r["player"], r["metric"], r["q"]) for r in out})


@pytest.mark.parametrize("finish", [100, 10])
def test_ranges_on_both_sides_of_a_dominating_value(spark, positions_of, finish):
    v = [i / 100 for i in range(55)] + [5.0] * 915 + [9 + i / 100 for i in range(30)]
    random.Random(1).shuffle(v)
    out = pc.percentiles(positions_of([dict(frame=i, speed=x) for i, x in enumerate(v)]), finish=finish).filter("metric = 'speed'").collect()
    want = [(q, len(v), rank_value(v, q)) for q in pc.WANTED]
    for level in ("player", "game_player"):
        assert sorted((r["q"], r["n"], r["value"]) for r in out if r["level"] == level) == want


def test_empty(spark, positions_of):
    assert pc.percentiles(positions_of([])).count() == 0


def test_combined_summaries_keep_their_bound(spark, positions_of, monkeypatch):
    monkeypatch.setattr(pc, "POINTS", 100)
    rng = np.random.default_rng(0)
    v = np.round(rng.exponential(1.0, 4000), 3)
    rows = [dict(game_id=f"g{i % 5}", clip=i % 7, frame=i, speed=float(x), dist_t=float(i % 3), ingested_at=dt.datetime(2025, 1, 1 + i % 4)) for i, x in enumerate(v)]
    monkeypatch.setattr(pc, "FAN_IN", 8)
    parts = pc.summaries(positions_of(rows), ["day", "game_id", "player"])
    assert parts.select("day", "game_id", "player", "metric").distinct().count() == 4 * 5 * 2
    out = pc.of_summary(pc.combine(parts, ["player"]), ["player"]).collect()
    s = np.sort(v)
    for r in (r for r in out if r["metric"] == "speed"):
        rank, low, high = max(1, math.ceil(r["q"] * 4000)), np.searchsorted(s, r["value"], "left") + 1, np.searchsorted(s, r["value"], "right")
        assert r["n"] == 4000 and max(low - rank, rank - high, 0) <= r["rank_error"] < 4000 / 4
    assert {r["value"] for r in out if r["metric"] == "dist_t" and r["q"] == 0.99} == {2.0}


def test_condense_keeps_weight_and_error():
    rng = np.random.default_rng(1)
    v = np.concatenate([np.sort(rng.normal(size=5000)), np.sort(rng.normal(size=80)), [1.0]])
    w, start = rng.integers(1, 9, 5081), np.array([0, 5000, 5080, 5081])
    kept, merged, error = pc.condense(v, w, start, 100)
    for a, b, e in zip(start[:-1], start[1:], error):
        own = (kept >= a) & (kept < b)
        assert merged[own].sum() == w[a:b].sum() and own.sum() <= 210 and kept[own][-1] == b - 1
        assert e <= w[a:b].sum() / 100 + 9 and (b - a > 100 or e == 0)


def test_weighted_median_of_each_part():
    rng = np.random.default_rng(4)
    h, part, value, weight = rng.integers(0, 3, 500), rng.integers(1, 4, 500), np.round(rng.normal(size=500), 1), rng.integers(1, 9, 500)
    for i, p, v, w in zip(*pc.weighted_median(h, part, value, weight)):
        own = (h == i) & (part == p)
        all_ = np.sort(np.repeat(value[own], weight[own]))
        assert w == len(all_) and v == all_[(w + 1) // 2 - 1]


def test_medians_in_two_stages_and_shuffled_ranges(spark, positions_of, monkeypatch):
    monkeypatch.setattr(pc, "MEDIAN_OF", 1)
    monkeypatch.setattr(pc, "MOST_RANGES", 0)
    rng = np.random.default_rng(6)
    rows = [dict(game_id=f"g{i % 7}", clip=i % 40, frame=i, speed=round(float(v), 2)) for i, v in enumerate(rng.exponential(2.0, 3000))]
    out = pc.percentiles(positions_of(rows).repartition(6), finish=8).filter("metric = 'speed'").collect()
    for r in out:
        v = [x["speed"] for x in rows if r["level"] == "player" or x["game_id"] == r["game_id"]]
        assert (r["n"], r["value"]) == (len(v), rank_value(v, r["q"]))
    assert len(out) == 8 * len(pc.WANTED)


def test_checks_judge_every_percentile_beyond_the_broadcast(spark, positions_of, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "MOST_FOUND", 5)
    positions_of([dict(player=f"p{i % 3}", frame=i, speed=float(i)) for i in range(90)]).write.parquet(str(tmp_path / "positions.parquet"))
    got = queries.p5_checks(spark, str(tmp_path)).collect()
    assert len(got) == 3 * len(pc.METRICS) * len(pc.WANTED) and all(r["within"] for r in got)
