import numpy as np
import pytest

from rallyforge.operators import charts
from rallyforge.sources import files


def test_blur_keeps_the_whole_and_mirrors_at_the_ends():
    weights = np.zeros((39, 39))
    for a, b, w in charts.blur_matrix(39):
        weights[a, b] = w
    assert np.allclose(weights.sum(axis=0), 1) and np.allclose(weights, weights.T) and np.allclose(weights, weights[::-1, ::-1])
    assert weights[20, 20] > weights[20, 21] > weights[20, 25] > 0 == weights[20, 26]
    assert weights[0, 0] > weights[20, 20]  # what would leave the court stays in it


def test_smoothed_heatmap_is_in_percent(spark):
    bins = spark.createDataFrame([("g", 0, 0, 3), ("g", 20, 13, 1), ("h", 38, 25, 2)], "game_id string, yb bigint, xb bigint, n bigint")
    out = charts.smoothed_heatmap(bins, ["game_id"]).toPandas()
    assert out.groupby("game_id").percent.sum().tolist() == pytest.approx([100, 100])
    assert out[out.game_id == "h"].sort_values("percent").iloc[-1][["yb", "xb"]].tolist() == [38, 25]


def test_arrays_go_out_and_come_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    df = spark.createDataFrame(rows, "det_id bigint, embedding array<double>").repartition(3)
    written = files.write_arrays(df, str(tmp_path / "a"), "det_id", "embedding").collect()
    assert sum(r["rows"] for r in written) == 50
    ids = {(r["path"].rsplit("/", 1)[1][:5], r["row"]): int(r["values"][0]) for r in files.read_arrays(spark, str(tmp_path / "a"), "*.ids.npy").collect()}
    back = {ids[r["path"].rsplit("/", 1)[1][:5], r["row"]]: r["values"] for r in files.read_arrays(spark, str(tmp_path / "a"), "*.values.npy").collect()}
    assert back == dict(rows)
    assert files.write_arrays(df.limit(0), str(tmp_path / "b"), "det_id", "embedding").collect() == []


def test_background_samples(spark):
    games = spark.createDataFrame([("a", 10.0, 0.0, 80.0), ("b", 10.0, None, None), ("c", None, 0.0, 50.0), ("a", 10.0, 0.0, 80.0)], "game_id string, fps double, t_start double, t_end double")
    out = files.sample_frames(games, n=7).orderBy("sample").collect()
    assert [(r["game_id"], r["frame"]) for r in out] == [("a", f) for f in range(100, 701, 100)]
