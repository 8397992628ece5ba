import duckdb

import __spark_entry__ as entry
from rallyforge.plans.sql import POS, q
from rallyforge.sources import files

DATA = "/root/testdata/sf0.001"
GAMES = "game_id string, fps double, frame_stride int, t_start double, t_end double"


def test_each_game_is_sampled_by_its_own_record(spark):
    nan = float("nan")
    games = spark.createDataFrame([("a", 10.0, 2, 0.5, 1.2), ("b", 24.0, 5, 0.1, None), ("c", 10.0, None, 0.0, nan), ("a", 10.0, 2, 0.5, 1.2)], GAMES)
    frames = spark.createDataFrame([(g, f) for g in "abcd" for f in range(16)], "game_id string, frame bigint")
    out = files.sampled_by_game(frames, games).collect()
    kept = {g: sorted(r["frame"] for r in out if r["game_id"] == g) for g in "abcd"}
    assert kept == {"a": [5, 7, 9, 11], "b": [2, 7, 12], "c": [*range(16)], "d": [*range(16)]}
    assert {r["t"] for r in out if r["game_id"] == "b"} == {2 / 24, 7 / 24, 12 / 24} and {r["t"] for r in out if r["game_id"] == "d"} == {None}


def test_query_over_whole_tables(spark):
    con = duckdb.connect()
    for name in ("positions", "games"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    want = con.sql(q(POS, "c AS (SELECT pos.*, fps, coalesce(frame_stride, 1) AS s, CAST(trunc(g.t_start * fps) AS BIGINT) AS f0, CAST(trunc(g.t_end * fps) AS BIGINT) AS f1 FROM pos JOIN games g USING (game_id))",
                     select="SELECT game_id, clip, player, frame, frame / fps AS t FROM c WHERE frame >= f0 AND (f1 IS NULL OR frame <= f1) AND (frame - f0) % s = 0")).fetchall()
    got = [tuple(r) for r in entry.queries()["sampled_frames"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and want
