"""NULL in any column, repeated rows and extra columns with names that the operators use inside."""

from pyspark.sql import functions as F

from rallyforge.operators import regular_grid, spikes

CLASH = ["stride", "chunk", "own", "reading", "period", "block", "home", "__g1", "__g2", "missing", "x_fault", "before"]


def crowded(df):
    return df.select("*", *(F.lit(f"{c}!").alias(c) for c in CLASH if c not in df.columns))


def holed(df):
    parts = df
    for c in df.columns:
        parts = parts.unionByName(df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    return crowded(parts.unionByName(parts))


def test_positions(spark, positions_of, games_of):
    rows = [dict(frame=i, x=3 + i / 100, y=5 + i / 50, speed=1.0 + i / 100) for i in range(30)] + [dict(frame=40, x=7.0)]
    df = holed(positions_of(rows))
    flags = spikes.flag_faults(df, crowded(games_of(("g", 1), (None, 1), ("y", None)))).collect()
    assert {(r["game_id"], r["clip"], r["frame"]) for r in flags} >= {(None, 0, 40), ("g", None, 40)}
    grid = regular_grid.regular_grid(df).collect()
    assert {(r["game_id"], r["clip"]) for r in grid} == {("g", 0), (None, 0), ("g", None)}
    assert len(grid) == len({(r["game_id"], r["clip"], r["player"], r["period_no"]) for r in grid})
