import numpy as np
from pyspark.sql import functions as F

from rallyforge.operators.grouped import map_sorted_groups


def test_groups_are_whole_whatever_the_batches(spark):
    df = spark.range(5000).select((F.col("id") % 37).alias("k"), F.col("id").alias("v"), F.lit("x").alias("__g0"))
    df = df.unionByName(spark.range(3000).select(F.lit(99).cast("bigint").alias("k"), F.col("id").alias("v"), F.lit("y").alias("__g0")))

    def fn(g):
        assert (np.diff(g.start) > 0).all()
        v = g.column("v")
        return g.take(["k"], g.start[:-1]) | {"n": np.diff(g.start), "up": np.array([(np.diff(v[a:b]) > 0).all() for a, b in zip(g.start[:-1], g.start[1:])])}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        out = map_sorted_groups(df, ["k"], ["v"], fn, "k bigint, n bigint, up boolean", flush_rows=100).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(out) == 38 and all(r["up"] for r in out)
    assert {r["k"]: r["n"] for r in out} == {**{k: len(range(k, 5000, 37)) for k in range(37)}, 99: 3000}
