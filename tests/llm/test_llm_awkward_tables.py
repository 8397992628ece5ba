"""NULL in any column, repeated rows and extra columns with names that the operators use inside."""

from pyspark.sql import functions as F

from rallyforge.llm import encode, mix, percentiles, pieces, runs, splits

CLASH = ["stride", "chunk", "part", "run", "new", "v", "w", "n", "points", "salt", "own", "h", "bucket", "position", "key", "shape", "ends", "matches", "ids", "n_tokens", "metric", "value", "__g1", "u", "root", "bin"]


def crowded(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH if c not in df.columns))


def holed(df, key):
    """df and, for each column, its rows with that column NULL; all twice."""
    parts = df
    for c in df.columns:
        if c != key:
            parts = parts.unionByName(df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    return crowded(parts.unionByName(parts))


def test_positions(spark, positions_of, games_of):
    rows = [dict(frame=i, speed=1.0 + i / 1000) for i in range(12)]
    df = holed(positions_of(rows), None)
    out = runs.collapse_runs(df, crowded(games_of(("g", 1), (None, 2), ("x", None)))).collect()
    assert {(r["game_id"], r["clip"]) for r in out} == {("g", 0), (None, 0), ("g", None)}
    assert percentiles.percentiles(df).count() == 6 * 2 * (1 + 2)
    parts = percentiles.summaries(df, ["game_id", "player"])
    assert percentiles.combine(parts, ["player"]).count() == 2


def test_tracklets(spark):
    df = holed(spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 2), ("g", 3, 3)], "game_id string, det_id bigint, tracklet bigint"), None)
    assert {(r["game_id"], r["tracklet"], r["root"]) for r in splits.tie_components(df).collect()} == {("g", 2, 1), (None, 2, 1)}
    targets = crowded(spark.createDataFrame([("a", 0.5), ("b", 0.5), (None, None)], "split string, share double"))
    out = splits.assign_splits(df, targets, bins=4)
    assert out.count() == 6 and splits.shares(out, targets).count() == 2


def test_documents(spark):
    df = holed(spark.createDataFrame([(1, "word " * 60, "a"), (2, "x", " A")], "doc_id bigint, text string, source string"), None)
    n = df.count()
    assert encode.encode_texts(df).count() == n and encode.encode_texts(df).filter("ids IS NULL").count() == 0
    targets = crowded(spark.createDataFrame([("a", 1.0, 2), ("A ", 0.5, None), (None, 1.0, 1)], "source string, weight double, max_repeats int"))
    sized = mix.sized_records(df, targets)
    made = mix.mix(sized, targets)
    share = mix.shares(sized, made, targets).collect()
    assert len(share) == 1 and share[0]["actual_share"] == 1.0 and share[0]["most_repeats"] == 2
    limits = crowded(spark.createDataFrame([("s", 32, 4), (None, 32, None), ("none", None, 4)], "limit_name string, max_tokens int, overlap_tokens int"))
    out = pieces.cut(df, limits).collect()
    assert {r["limit_name"] for r in out} == {"s", None} and all(len(r["piece"]) > 0 for r in out)
