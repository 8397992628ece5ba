"""Tracks: regular frames, limited interpolation, Savitzky-Golay smoothing and speed. Windows by source only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.functions import court
from rallyforge.operators.signals import gradient

SOURCE = ["game_id", "clip", "player"]
WINDOW, DEGREE = 11, 2
#: Rows of the grid that are made at a time out of one gap.
SLICE = 4_096


def by_source():
    return Window.partitionBy(*SOURCE).orderBy("frame")


def savgol_fit(window: int = WINDOW, degree: int = DEGREE) -> np.ndarray:
    """Row d: the weights by which coefficient d of the polynomial fitted around the middle follows from the window's values."""
    return np.linalg.pinv(np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float))


def following(value: str, order: str = "frame") -> Column:
    """The next value of the column in the source that is not NULL, after this row. One pass: a frame that reaches to the end of
    the source would be gone through anew for every row."""
    return F.expr(f"lead({value}) IGNORE NULLS OVER (PARTITION BY {', '.join(SOURCE)} ORDER BY {order})")


def first_of_frame(rows: DataFrame) -> DataFrame:
    """The earliest row (by t) of each frame of a source."""
    before = F.lag("frame").over(Window.partitionBy(*SOURCE).orderBy("frame", "t"))
    return rows.withColumn("__b", before).filter("__b IS NULL OR __b <> frame").drop("__b")


def on_grid(rows: DataFrame, limits: dict[str, int | Column], step: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every frame of each source's grid from its first to its last row: SOURCE, keep..., frame, __n (number on the grid, from
    1), there (a row stands behind it), and the columns of limits, interpolated linearly by number between the neighbours with
    values; of a gap longer than its limit only the first rows are filled; nothing before the first and after the last value.

    The grid's step is the source's most frequent one (the smallest of several) unless given; rows off the grid are left out.
    No join: each row brings forth the grid's rows up to the next one, in slices, and knows the values around them."""
    w = by_source()
    if step is None:
        gaps = rows.withColumn("__gap", F.lead("frame").over(w) - F.col("frame"))
        gaps = gaps.withColumn("__c", F.count("__gap").over(Window.partitionBy(*SOURCE, "__gap")))
        best = F.max(F.when(F.col("__gap").isNotNull(), F.struct("__c", (-F.col("__gap")).alias("g")))).over(Window.partitionBy(*SOURCE))
        rows = gaps.withColumn("__step", F.coalesce(-best["g"], F.lit(1))).drop("__gap", "__c")
    else:
        rows = rows.withColumn("__step", F.lit(step))
    rows = rows.withColumn("__n", (F.col("frame") - F.min("frame").over(Window.partitionBy(*SOURCE))) / F.col("__step") + 1).filter("__n = floor(__n)").withColumn("__n", F.col("__n").cast("bigint"))
    for c in limits:
        rows = rows.withColumn(f"__h_{c}", F.when(F.col(c).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(c).cast("double").alias("v"))))
    rows = rows.select(
        *SOURCE, *keep, "frame", "__n", "__step", (F.lead("__n").over(w) - F.col("__n") - 1).alias("__more"),
        *(F.last(f"__h_{c}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"__b_{c}") for c in limits), *(following(f"__h_{c}").alias(f"__a_{c}") for c in limits),
    )
    more = F.coalesce("__more", F.lit(0))
    slices = rows.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(more / SLICE)))).withColumn("__k", F.explode(F.sequence(F.col("__s") * SLICE, F.least(more, F.col("__s") * SLICE + (SLICE - 1)))))
    grid = slices.select(*SOURCE, *keep, (F.col("frame") + F.col("__k") * F.col("__step")).alias("frame"), (F.col("__n") + F.col("__k")).alias("__n"), (F.col("__k") == 0).alias("there"), *(f"__{x}_{c}" for c in limits for x in "ba"))
    return grid.select(*SOURCE, *keep, "frame", "__n", "there", *(_between(F.col(f"__b_{c}"), F.col(f"__a_{c}"), limit).alias(c) for c, limit in limits.items()))


def _between(before: Column, after: Column, limit: int | Column) -> Column:
    past = F.col("__n") - before["n"]
    return F.when(past == 0, before["v"]).when((past <= limit) & after["n"].isNotNull(), before["v"] + (after["v"] - before["v"]) * past / (after["n"] - before["n"]))


def interpolate(value: str, limit: int | Column) -> Column:
    """The same within rows that are on a grid already (numbered __n); needs the column value + "__h" of `held`."""
    w = by_source()
    here = f"{value}__h"
    return _between(F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), following(here), limit)


def held(rows: DataFrame, value: str) -> DataFrame:
    return rows.withColumn(f"{value}__h", F.when(F.col(value).isNotNull(), F.struct(F.col("__n").alias("n"), F.col(value).cast("double").alias("v"))))


def smooth_tracks(rows: DataFrame, rates: DataFrame, max_gap_s: float = 0.6, max_speed: float = 8.0) -> DataFrame:
    """rows (game_id, clip, player, frame, t, x, y, conf) on the regular grid: interpolated, smoothed, clipped to the court,
    with speed and dist_t. Rows are shuffled once, by source; all windows share that and one order."""
    rated = rows.select(*SOURCE, "frame", "t", "x", "y", "conf").join(rates.select("game_id", "clip", F.floor(max_gap_s * F.col("fps_eff")).alias("__limit")), ["game_id", "clip"], "left")
    limit, w = F.col("__limit"), by_source()
    filled = on_grid(first_of_frame(rated).withColumn("__x", F.col("x")), {"t": 2**62, "x": limit, "y": limit, "conf": limit, "__x": 0}, keep=("__limit",))
    filled = filled.withColumn("interpolated", F.col("__x").isNull()).withColumn("valid", F.col("x").isNotNull())
    change = F.when(F.col("valid").eqNullSafe(F.lag("valid").over(w)), None).otherwise(F.col("__n"))
    runs = filled.withColumn("__c", change).withColumn("__end", F.coalesce(following("__c"), F.max("__n").over(Window.partitionBy(*SOURCE)) + 1))
    runs = runs.withColumn("__begin", F.last("__c", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    half = WINDOW // 2
    behind, ahead = F.col("__n") - F.col("__begin"), F.col("__end") - 1 - F.col("__n")
    near = runs.select(
        *SOURCE, "frame", "__n", "t", "x", "y", "conf", "interpolated", "valid", behind.alias("__u"), ahead.alias("__d"), *(F.lag(c, -k).over(w).alias(f"__{c}{k}") for c in "xy" for k in range(-half, half + 1) if k)
    )
    # a polynomial is fitted around each row; the first rows of a run are read off that of its first full window, the last ones
    # off that of its last
    fit = savgol_fit()

    def coefficient(c: str, d: int) -> Column:
        terms = [float(fit[d, k + half]) * (F.col(f"__{c}{k}") if k else F.col(c)) for k in range(-half, half + 1)]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return total

    u, d = F.col("__u"), F.col("__d")
    whole = F.struct(*(coefficient(c, k).alias(f"{c}{k}") for c in "xy" for k in range(DEGREE + 1)))
    full = F.col("valid") & (u + d + 1 >= WINDOW)
    fitted = near.select(
        *SOURCE, "frame", "__n", "t", "x", "y", "conf", "interpolated", "valid", "__u", "__d", coefficient("x", 0).alias("__x"), coefficient("y", 0).alias("__y"),
        F.when(full & (u == half), whole).alias("__first"), F.when(full & (d == half), whole).alias("__last"),
    )
    fitted = fitted.withColumn("__first", following("__first")).withColumn("__last", F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def smoothed(c: str) -> Column:
        at = lambda poly, o: sum(F.col(f"{poly}.{c}{k}") * (o**k if k > 1 else o if k else F.lit(1)) for k in range(DEGREE + 1))
        return F.when(~full, F.col(c)).when(u < half, at("__first", (u - half).cast("double"))).when(d < half, at("__last", (half - d).cast("double"))).otherwise(F.col(f"__{c}"))

    placed = fitted.select(*SOURCE, "frame", "__n", "t", court.clip(smoothed("x"), 0.0, court.WIDTH).alias("x"), court.clip(smoothed("y"), 0.0, court.LENGTH).alias("y"), "conf", "interpolated", "valid")
    dt = gradient("t", w)
    speed = F.hypot(gradient("x", w) / dt, gradient("y", w) / dt)
    timed = held(placed.withColumn("v", F.when(F.col("valid") & (speed <= max_speed), speed)), "v")
    return timed.withColumn("speed", interpolate("v", 2)).select(
        *SOURCE, "frame", "t", "x", "y", "speed", court.dist_to_t(F.col("x"), F.col("y")).alias("dist_t"), "conf", "interpolated"
    )


def every_frame(tracks: DataFrame, limit: int = 3) -> DataFrame:
    """Each frame number between a source's rows, with x and y interpolated over at most `limit` frames (for overlays)."""
    return on_grid(tracks.select(*SOURCE, "frame", "x", "y"), {"x": limit, "y": limit}, step=1).select(*SOURCE, "frame", "x", "y")
