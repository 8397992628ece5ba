"""Signals of a clip (both players side by side), and thresholds from the clip's own pace.

A clip (game_id, clip) is one recording; frames and times belong to it. Windows partition by clip: a recording is
bounded, and a game with many clips spreads over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.islands import with_runs

CLIP = ["game_id", "clip"]
#: Length of a window in the numbering of rows that activity uses.
SPAN = 1_000_000_000


def by_frame():
    return Window.partitionBy(*CLIP).orderBy("frame")


def side_by_side(pos: DataFrame) -> DataFrame:
    """One row per frame of a clip: t (p1's, else p2's) and x, y, speed, dist_t of p1 and p2 as x1, x2, ..."""
    of = lambda c, p: F.max(F.when(F.col("player") == p, F.col(c)))
    both = [of(c, p).alias(f"{n}{p[1]}") for p in ("p1", "p2") for c, n in (("x", "x"), ("y", "y"), ("speed", "v"), ("dist_t", "d"))]
    rows = pos.filter(F.col("player").isin("p1", "p2"))
    # clustered by clip already, so the windows that follow need no shuffle of their own
    return rows.repartition(*CLIP).groupBy(*CLIP, "frame").agg(F.coalesce(of("t", "p1"), of("t", "p2")).alias("t"), *both)


def sample_rate(rows: DataFrame, keys: list[str] = CLIP) -> DataFrame:
    """keys..., fps_eff: readings a second, one over the median distance of successive distinct times."""
    times = rows.filter("t IS NOT NULL").select(*keys, "t").distinct()
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("t"))
    return times.withColumn("gap", gap).groupBy(*keys).agg((1 / F.median("gap")).alias("fps_eff"))


def rate_of_frames(rows: DataFrame, keys: list[str] = CLIP) -> DataFrame:
    """keys..., fps_eff: readings a second by the frame numbers themselves, median(frame / t) / stride (a column of rows); for
    rows whose times are frame / fps."""
    known = rows.filter("frame > 0 AND t <> 0")
    return known.groupBy(*keys).agg((F.median(F.col("frame") / F.col("t")) / F.max("stride")).alias("fps_eff"))


def activity(wide: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds activity: the centred mean of v1 + v2 (missing: 0) over about a second of rows, and fps_eff.

    The number of rows, w = max(3, round(fps_eff)), differs from clip to clip, which a ROWS frame cannot express; rows
    are numbered in units of w / SPAN instead, so a RANGE frame of one width holds w rows in every clip (up to a hundred
    million rows a second; a rate beyond counts as that)."""
    w = F.greatest(F.lit(3), F.least(F.rint("fps_eff"), F.lit(1e8)).cast("bigint"))
    joined = wide.join(rates, CLIP)
    # half of w before, the rest after; numbers are off by at most one, neighbours lie SPAN / w >= 10 apart
    numbered = joined.withColumn("at", F.round(F.row_number().over(by_frame()).cast("double") * SPAN / w).cast("bigint"))
    frame = Window.partitionBy(*CLIP).orderBy("at").rangeBetween(-(SPAN // 2 + 2), SPAN // 2 - 3)
    pace = F.coalesce("v1", F.lit(0.0)) + F.coalesce("v2", F.lit(0.0))
    return numbered.withColumn("pace", pace).withColumn("activity", F.avg("pace").over(frame)).drop("at", "pace")


def both_still(limit: float = 0.6) -> Column:
    """Over five rows, two of them with a reading at least, both players' mean speed stays below the limit."""
    five = by_frame().rowsBetween(-2, 2)
    slow = lambda v: F.coalesce(F.when(F.count(v).over(five) >= 2, F.avg(v).over(five)), F.lit(9.0)) < limit
    return slow("v1") & slow("v2")


def pace_parameters(active: DataFrame, pos: DataFrame, overrides: dict[str, float] | None = None) -> DataFrame:
    """One row per clip with its thresholds: exact percentiles of its activity and speeds, with floors. Overrides pin any
    of them by name."""
    a = active.groupBy(*CLIP).agg(F.percentile("activity", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75)))).alias("a"), F.max("fps_eff").alias("fps_eff"))
    s = pos.groupBy(*CLIP).agg(F.percentile("speed", F.lit(0.1)).alias("s10"))
    top = lambda floor, c: F.greatest(F.lit(floor), c)
    a10, a25, a50, a75 = (F.get("a", F.lit(i)) for i in range(4))
    made = {
        "trough_lo": top(0.8, 1.1 * a10), "lull_act": top(1.6, a25), "act_play": top(2.0, 0.85 * a50), "min_play_act": top(3.0, a75),
        "slow": top(0.8, 2.5 * F.col("s10")), "relax_slow": top(1.0, 3.2 * F.col("s10")), "serve_min_s": top(0.4, 4.0 / F.col("fps_eff")),
    }
    pinned = {k.lower(): F.lit(float(v)) for k, v in (overrides or {}).items()}
    return a.join(s, CLIP, "left").select(*CLIP, "fps_eff", *((pinned.get(k, v)).alias(k) for k, v in made.items()))


def gradient(value: str | Column, w) -> Column:
    """Central difference, one-sided in the first and last row (by position: a missing neighbour gives NULL)."""
    c = F.col(value) if isinstance(value, str) else value
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first & last, None).when(first, after - c).when(last, c - before).otherwise((after - before) / 2)


def path_steps(keys: list[str], order: list[str]) -> Column:
    """Way from the row before; 0 where either end is missing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))


def trail(pos: DataFrame, seconds: int = 2) -> DataFrame:
    """Adds trail: the points of the last seconds, oldest first (time in whole milliseconds for the frame)."""
    w = Window.partitionBy("game_id", "clip", "player").orderBy("ms").rangeBetween(-1000 * seconds, 0)
    timed = pos.filter("t IS NOT NULL").withColumn("ms", F.round(F.col("t") * 1000).cast("bigint"))
    return timed.withColumn("trail", F.collect_list(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))).over(w))


__all__ = ["CLIP", "activity", "both_still", "gradient", "pace_parameters", "path_steps", "sample_rate", "side_by_side", "trail", "with_runs"]
