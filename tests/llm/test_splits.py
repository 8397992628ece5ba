import random

import numpy as np
import pytest

from rallyforge.llm import splits

SCHEMA = "game_id string, det_id bigint, tracklet bigint"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for g, d, t in rows:
        if d is not None and t not in (None, -1):
            parent.setdefault((g, t), (g, t))
            by.setdefault((g, d), []).append((g, t))
    for ts in by.values():
        for t in ts[1:]:
            a, b = find(ts[0]), find(t)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return {(g, find((g, t))[1], t) for g, t in parent if find((g, t))[1] != t}


def test_components_against_union_find(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, *range(60)]), rng.choice([None, -1, *range(70)])) for _ in range(150)]
    rows += [("c", i, i) for i in range(30)] + [("c", i, i + 1) for i in range(30)]  # a long chain
    rows += [("d", 1, t) for t in range(50)] + rows[:20]  # one detection with very many tracklets
    got = {(r["game_id"], r["root"], r["tracklet"]) for r in splits.tie_components(table(spark, rows)).collect()}
    assert got == brute(rows)


def test_nothing_to_tie(spark):
    assert splits.tie_components(table(spark, [])).count() == 0
    assert splits.tie_components(table(spark, [("a", None, 1), ("a", None, 2), ("a", 1, -1), ("a", 1, 5), (None, 2, None)])).count() == 0


@pytest.mark.parametrize("group_rows", [50_000, 40])
def test_splits_keep_components_and_shares(spark, group_rows):
    rng = random.Random(2)
    rows = [("g", d, d // rng.choice([3, 7, 20])) for d in range(3000)] + [("h", d, rng.choice([None, -1])) for d in range(800)]
    rows += [("h", 5, 1), ("h", 5, -1), ("h", 6, 1), ("h", None, 2)] + rows[:100]
    targets = spark.createDataFrame([("test", 0.1), ("train", 0.8), ("validation", 0.1), (None, 0.5)], "split string, share double")
    out = splits.assign_splits(table(spark, rows), targets, bins=50, group_rows=group_rows, fan_in=3).collect()
    assert len(out) == len({(r["game_id"], r["det_id"]) for r in out}) == 3800
    by = {(r["game_id"], r["det_id"]): r["split"] for r in out}
    assert by["h", 5] == by["h", 6]
    roots = {(g, t): r for g, r, t in brute(rows)}
    seen = {}
    for g, d, t in rows:
        if d is not None and t not in (None, -1):
            assert seen.setdefault((g, roots.get((g, t), t)), by[g, d]) == by[g, d]
    n = {s: sum(v == s for v in by.values()) for s in ("train", "test", "validation")}
    assert abs(n["train"] / 3800 - 0.8) < 0.03 and abs(n["test"] / 3800 - 0.1) < 0.03


def test_giant_component_and_zero_shares(spark):
    rows = [("g", d, 1) for d in range(500)] + [("g", 1000 + d, None) for d in range(100)]
    targets = spark.createDataFrame([("a", 0.0), ("b", None), ("c", -1.0)], "split string, share double")
    out = splits.assign_splits(table(spark, rows), targets, bins=10)
    assert out.count() == 600 and out.filter("det_id < 500").select("split").distinct().count() == 1
    s = {r["split"]: r for r in splits.shares(out, targets).collect()}
    assert abs(sum(r["share"] for r in s.values()) - 1) < 1e-9 and len(s) == 3


def test_empty_table_gives_no_rows(spark):
    targets = spark.createDataFrame([("a", 1.0)], "split string, share double")
    assert splits.assign_splits(table(spark, []), targets).count() == 0


def test_largest_differencing():
    rng = np.random.default_rng(0)
    w = rng.integers(2, 50, 400)
    sums, places = splits.difference([np.array([x], float) for x in w], 10)
    assert (np.bincount([p[0] for p in places], weights=w, minlength=10) == sums).all()
    assert sums.max() - sums.min() <= 2
    assert splits.fill(np.array([5.0, 3, 9, 1]), 7).tolist() == [1, 2, 0, 4]
