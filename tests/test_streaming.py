"""Streams over several small files, each a batch of its own."""

import datetime as dt
import os

import pytest

from rallyforge.streaming import live

SCHEMA = "game_id string, clip int, rally int, server string, box string, ts timestamp"
T0 = dt.datetime(2025, 1, 1)


def drained(spark, tmp_path, batches, schema, stream):
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        os.makedirs(folder, exist_ok=True)
        part = next(f for f in os.listdir(tmp_path / f"b{i}") if f.endswith(".parquet"))
        os.replace(tmp_path / f"b{i}" / part, folder / f"{i:03d}.parquet")
        os.utime(folder / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def rally(no, server, box, clip=0, minute=None):
    return ("g", clip, no, server, box, T0 + dt.timedelta(minutes=no if minute is None else minute))


def test_rallies_out_of_order_and_a_game_that_ends(spark, tmp_path):
    batches = [
        [rally(1, "p1", "left"), rally(3, "p2", "left")], [rally(2, "p2", "right"), rally(2, "p2", "right")], [rally(4, "p2", "left"), rally(6, "p1", "right")],
        [rally(5, None, None)], [rally(1, "p1", "left", clip=9, minute=600), rally(1, "p1", "left")],
    ]
    got = drained(spark, tmp_path, batches, SCHEMA, lambda s: live.running_score(s, "1 minute", 60)).orderBy("clip", "rally").collect()
    assert [(r["rally"], r["winner"], r["score_p1"], r["score_p2"], r["final"]) for r in got if r["clip"] == 0] == [
        (1, "p2", 0, 1, False), (2, "p2", 0, 2, False), (3, None, 0, 2, False), (4, None, 0, 2, False), (5, None, 0, 2, False), (6, None, 0, 2, True),
    ]


def test_the_last_rally_is_decided_by_game_ball(spark, tmp_path):
    rows = [rally(i, "p1", ["left", "right"][i % 2]) for i in range(1, 16)]
    got = drained(spark, tmp_path, [rows, [rally(1, "p2", "left", clip=1, minute=900)]], SCHEMA, lambda s: live.running_score(s, "1 minute", 60))
    last = got.filter("clip = 0").orderBy("rally").collect()[-1]
    assert (last["rally"], last["winner"], last["score_p1"], last["final"]) == (15, "p1", 15, True)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_corrections_are_not_lost(spark, tmp_path, order):
    schema = "game_id string, clip int, player string, frame bigint, x double, ingested_at timestamp"
    made = [[("g", 0, "p1", 1, float(i), T0 + dt.timedelta(hours=i)), ("g", 0, "p1", 2, 7.0, T0)] for i in range(3)]
    written = drained(spark, tmp_path, [made[i] for i in order], schema, live.versions)
    assert written.count() == 4  # three versions of one key, copies of the other once
    assert {(r["frame"], r["x"]) for r in live.newest_of(written).collect()} == {(1, 2.0), (2, 7.0)}


def test_versions_without_a_time_count_last(spark, tmp_path):
    schema = "game_id string, clip int, player string, frame bigint, x double, ingested_at timestamp"
    rows = [("g", 0, "p1", 1, 1.0, None), ("g", 0, "p1", 2, 2.0, None), ("g", 0, "p1", 2, 3.0, T0)]
    written = drained(spark, tmp_path, [rows], schema, live.versions)
    assert {(r["frame"], r["x"]) for r in live.newest_of(written).collect()} == {(1, 1.0), (2, 3.0)}
