from rallyforge.plans import queries


def test_each_game_has_its_own_stride(spark, positions_of, games_of, tmp_path):
    # two strides are missed in g, five in h
    rows = [dict(game_id=g, frame=f) for g, frames in (("g", (0, 5, 20)), ("h", (0, 1, 7))) for f in frames]
    positions_of(rows).write.parquet(str(tmp_path / "positions.parquet"))
    games_of(("g", 5), ("h", 1)).write.parquet(str(tmp_path / "games.parquet"))
    found = {(r["game_id"], r["frame"]): r["tracklet"] for r in queries.build_tracklets(spark, str(tmp_path)).collect()}
    assert found == {("g", 0): 0, ("g", 5): 0, ("g", 20): 0, ("h", 0): 0, ("h", 1): 0, ("h", 7): 1}
