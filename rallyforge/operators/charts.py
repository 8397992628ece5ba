"""Data behind charts: smoothed heat maps, the distance from the T over time, paths in a grid of panels, comparisons."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.asof import with_last
from rallyforge.operators.metrics import WHO
from rallyforge.operators.signals import CLIP

ROWS, COLUMNS = 39, 26
SIGMA = 1.2


def blur_matrix(size: int, sigma: float = SIGMA) -> list[tuple[int, int, float]]:
    """(from, to, weight) of a Gaussian blur of so many cells, cut off at four deviations and mirrored at both ends."""
    reach = int(4 * sigma + 0.5)
    offsets = np.arange(-reach, reach + 1)
    kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
    kernel /= kernel.sum()
    weights = np.zeros((size, size))
    for to in range(size):
        at = (to + offsets) % (2 * size)
        np.add.at(weights[:, to], np.where(at < size, at, 2 * size - 1 - at), kernel)
    return [(int(a), int(b), float(weights[a, b])) for a, b in zip(*np.nonzero(weights))]


def smoothed_heatmap(bins: DataFrame, keys: list[str], sigma: float = SIGMA) -> DataFrame:
    """keys..., yb, xb, percent: where time was spent, in percent of all, after a Gaussian blur. bins: keys..., yb, xb, n. The blur
    goes along one axis at a time: each filled bin gives to the few around it, by a join with a table of fixed size."""
    spark, made = bins.sparkSession, bins.withColumn("v", F.col("n").cast("double"))
    for axis, size in (("yb", ROWS), ("xb", COLUMNS)):
        table = spark.createDataFrame(blur_matrix(size, sigma), f"{axis} bigint, __to bigint, __w double")
        other = "xb" if axis == "yb" else "yb"
        given = made.join(F.broadcast(table), axis)  # at most ROWS x ROWS rows
        made = given.groupBy(*keys, F.col("__to").alias(axis), other).agg(F.sum(F.col("v") * F.col("__w")).alias("v"))
    return made.select(*keys, "yb", "xb", (F.col("v") / F.sum("v").over(Window.partitionBy(*keys)) * 100).alias("percent"))


def t_timeline(pos: DataFrame, rallies: DataFrame, panels: int = 3, margin_s: float = 5.0) -> DataFrame:
    """Readings by panel: clip, player, frame, t, dist_t, panel (from 0), rally (that they lie in). The time from the first
    rally to the last, with a margin, is cut into equal panels; a reading on an edge is in both."""
    spans = rallies.groupBy(*CLIP).agg((F.min("t_start") - margin_s).alias("__a"), (F.max("t_end") + margin_s).alias("__b"))
    rows = pos.filter("t IS NOT NULL").select(*WHO, "frame", "t", "dist_t").join(spans, CLIP)
    edge = lambda k: F.col("__a") + (F.col("__b") - F.col("__a")) * k / panels
    each = rows.withColumn("panel", F.explode(F.sequence(F.lit(0), F.lit(panels - 1)))).filter((F.col("t") >= edge(F.col("panel"))) & (F.col("t") <= edge(F.col("panel") + 1)))
    starts = rallies.select(*CLIP, F.col("t_start").alias("__s"), F.col("t_end").alias("__e"), "rally").unionByName(
        spans.select(*CLIP, F.col("__a").alias("__s"), F.col("__a").alias("__e"), F.lit(None).cast("int").alias("rally"))
    )
    shaded = with_last(each, starts, "__s")
    return shaded.select(*WHO, "frame", "t", "dist_t", "panel", F.when(F.col("t") <= F.col("__e"), F.col("rally")).alias("rally"))


def trajectories(pos: DataFrame, rallies: DataFrame, columns: int = 6) -> DataFrame:
    """One row per rally and player: row and column of its panel (rallies in order, so many in a row), the path as an array of
    places in the order of frames, the place at the serve."""
    w = Window.partitionBy(*CLIP).orderBy("rally")
    placed = rallies.select(*CLIP, "rally", "t_start", "t_end", (F.row_number().over(w) - 1).alias("__i"))
    rows = with_last(pos.select(*WHO, "frame", "t", "x", "y"), placed, "t_start").filter("t <= t_end")
    made = rows.groupBy(*WHO, "rally", "__i").agg(F.sort_array(F.collect_list(F.struct("frame", "x", "y"))).alias("path"))
    return made.select(*WHO, "rally", F.floor(F.col("__i") / columns).alias("row"), (F.col("__i") % columns).alias("column"), "path", F.get("path", F.lit(0)).alias("at_serve"))


def comparison(by_player: DataFrame, columns: list[str]) -> DataFrame:
    """One row per clip and metric: p1, p2, and by how much p1 has more."""
    long = by_player.unpivot([*WHO], columns, "metric", "value")
    wide = long.groupBy(*CLIP, "metric").agg(*(F.max(F.when(F.col("player") == p, F.col("value"))).alias(p) for p in ("p1", "p2")))
    return wide.withColumn("difference", F.col("p1") - F.col("p2"))
