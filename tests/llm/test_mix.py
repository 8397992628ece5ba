import pytest

from rallyforge.llm import mix

TARGETS = "source string, weight double, max_repeats int"


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id bigint, source string, text string")


def mixed(spark, rows, targets, **kw):
    t = spark.createDataFrame(targets, TARGETS)
    sized = mix.sized_records(docs(spark, rows), t)
    m = mix.mix(sized, t, **kw)
    return m.collect(), {r["source"]: r for r in mix.shares(sized, m, t).collect()}


def test_shares_repeats_and_prefixes(spark):
    rows = [(" A ", "a b c d " * 5)] * 400 + [("b", "x y z " * 7)] * 300 + [("C", "one two " * 4)] * 20 + [(None, "q")] * 5 + [("d", "w")] * 5 + [("a", ""), ("a", None)]
    targets = [("a", 0.5, 1), ("B", 0.3, 2), ("c", 0.2, 8), ("none", 0.1, 3), ("d", 0.0, 2)]
    out, share = mixed(spark, rows, targets, block=64, bucket_rows=50)
    assert all(abs(share[s]["actual_share"] - share[s]["target_share"]) < 0.01 for s in share)
    assert share["c"]["target_share"] == pytest.approx(0.2) and share["none"]["mix_tokens"] == share["d"]["mix_tokens"] == 0
    assert max(r["repeat_no"] for r in out if r["source"] == "c") == 8 and max(r["repeat_no"] for r in out if r["source"] == "a") == 1
    assert len(out) == len({(r["doc_id"], r["repeat_no"]) for r in out})
    run, total, longest = {s: 0 for s in "abc"}, 0, max(r["n_tokens"] for r in out)
    for r in sorted(out, key=lambda r: (r["slot"], r["position"])):
        run[r["source"]] += r["n_tokens"]
        total += r["n_tokens"]
        assert all(abs(run[s] - share[s]["target_share"] * total) < 2 * 64 + 2 * longest for s in run)


def test_positions_do_not_depend_on_buckets(spark):
    rows = [("a", "w " * (i % 9 + 1)) for i in range(300)] + [("b", "v " * (i % 5 + 1)) for i in range(300)]
    one, _ = mixed(spark, rows, [("a", 1.0, 1), ("b", 1.0, 1)], bucket_rows=10**6)
    many, _ = mixed(spark, rows, [("a", 1.0, 1), ("b", 1.0, 1)], bucket_rows=10)
    assert sum(r["n_tokens"] for r in one) == pytest.approx(sum(r["n_tokens"] for r in many), rel=0.02)
    per = sorted((r["position"], r["n_tokens"]) for r in many if r["source"] == "a")
    assert all(p + n == q for (p, n), (q, _) in zip(per, per[1:]))


def test_smaller_total(spark):
    out, share = mixed(spark, [("a", "w " * 10)] * 100 + [("b", "w " * 10)] * 100, [("a", 0.75, 1), ("b", 0.25, 1)], total_tokens=400)
    assert abs(sum(r["n_tokens"] for r in out) - 400) <= 22 and share["a"]["actual_share"] == pytest.approx(0.75, abs=0.03)


def test_nothing_available(spark):
    assert mixed(spark, [], [("a", 1.0, 1)])[0] == []
    out, share = mixed(spark, [("a", "x")], [("a", None, 1), ("b", 1.0, None), (None, 1.0, 1), ("c", float("nan"), 2)])
    assert out == [] and share["a"]["actual_share"] is None


def test_pfair_lags_stay_below_one_block():
    for rates in ([22, 20, 8, 10, 12, 10, 2, 6, 5, 2, 1], [1], [1, 1, 1], [99, 1], [7, 5, 3, 2, 2, 1]):
        slots, period = mix.pfair(rates), sum(rates)
        assert sorted(t for s in slots for t in s) == list(range(period))
        for rate, at in zip(rates, slots):
            assert len(at) == rate
            for j, t in enumerate(at):
                assert j * period // rate <= t < -(-(j + 1) * period // rate)


def test_weights_of_any_size(spark):
    assert mix.whole_rates({"a": 0.5, "b": 0.3, "c": 0.2}) == {"a": 5, "b": 3, "c": 2}
    assert mix.whole_rates({"a": 1000.5, "b": 1.0}) == {"a": 2001, "b": 2}
    assert mix.whole_rates({"a": 1e-9, "b": 3e-9}) == {"a": 1, "b": 3}
    for weights in ({"a": 0.9999996, "b": 4e-7}, {"a": 1000.123457, "b": 1.0}, {f"s{i}": 1e-12 for i in range(500)} | {"big": 1e300}, {"a": 1 / 3, "b": 1 / 7, "c": 1 / 11}):
        rates = mix.whole_rates(weights)
        assert sum(rates.values()) <= mix.MOST_SLOTS and min(rates.values()) >= 1
        if len(weights) < 10:
            assert all(abs(rates[s] / sum(rates.values()) - w / sum(weights.values())) <= 1 / mix.MOST_SLOTS for s, w in weights.items())
    out, share = mixed(spark, [("a", "w " * 10)] * 40 + [("b", "w")] * 3, [("a", 0.9999996, 1), ("b", 4e-7, 50), ("c", float("inf"), 1)])
    assert share["a"]["mix_tokens"] > 0 and share["b"]["records"] == 3 and share["c"]["target_share"] == 0


def test_only_what_can_be_drawn_is_sized(spark):
    t = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 1), ("c", 1.0, 0)], TARGETS)
    d = docs(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("d", "x")])
    assert [r["source"] for r in mix.sized_records(d, t, drawn_only=True).collect()] == ["a"]
    assert mix.sized_records(d, t).count() == 3
