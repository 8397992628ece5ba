"""Gaps and islands: runs of successive rows, and statistics of the runs. Built-in windows only.

``keys`` partition, ``order`` sorts; a run is a longest series of successive rows with an equal, non-NULL state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_runs(df: DataFrame, keys: list[str], order: list[str], state: Column, run: str = "run", value: str = "state") -> DataFrame:
    """Adds the state and the number of its run; rows with a NULL state separate runs and are kept."""
    w = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn(value, state)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return marked.withColumn("__new", change).withColumn(run, F.sum("__new").over(w)).drop("__new")


def runs(df: DataFrame, keys: list[str], order: list[str], state: Column, *aggregates: Column) -> DataFrame:
    """keys..., state, n and the aggregates of each run."""
    return with_runs(df, keys, order, state).filter("state IS NOT NULL").groupBy(*keys, "run", "state").agg(F.count("*").alias("n"), *aggregates).drop("run")


def longest_run(df: DataFrame, keys: list[str], order: list[str], state: Column) -> DataFrame:
    """keys..., state, longest: the length of the longest run of each state."""
    return runs(df, keys, order, state).groupBy(*keys, "state").agg(F.max("n").alias("longest"))


def bursts(df: DataFrame, keys: list[str], order: list[str], fast: Column, t: str = "t", least_s: float = 0.5) -> DataFrame:
    """keys..., bursts: runs of fast rows that last at least least_s from their first to their last row."""
    found = runs(df, keys, order, F.when(fast, True), F.min(t).alias("a"), F.max(t).alias("b"))
    counted = found.groupBy(*keys).agg(F.sum((F.col("b") - F.col("a") >= least_s).cast("int")).alias("bursts"))
    return df.select(*keys).distinct().join(counted, keys, "left").withColumn("bursts", F.coalesce("bursts", F.lit(0)).cast("bigint"))


def excursions(df: DataFrame, keys: list[str], order: list[str], out: Column, t: str = "t", most_s: float = 15.0) -> DataFrame:
    """keys..., n_excursions, recovery_s (median): from the first row of a run of out rows to the first row after it; runs
    that nothing follows or that take most_s or more do not count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    state = F.coalesce(out, F.lit(False))
    marked = with_runs(df.withColumn("__after", F.lead(t).over(w)), keys, order, state)
    found = marked.filter("state").groupBy(*keys, "run").agg(F.min(F.struct(*order, t)).getField(t).alias("a"), F.max(F.struct(*order, "__after")).getField("__after").alias("b"))
    took = F.when(F.col("b") - F.col("a") < most_s, F.col("b") - F.col("a"))
    counted = found.groupBy(*keys).agg(F.count(took).alias("n_excursions"), F.median(took).alias("recovery_s"))
    return df.select(*keys).distinct().join(counted, keys, "left").withColumn("n_excursions", F.coalesce("n_excursions", F.lit(0)))


def hysteresis(df: DataFrame, keys: list[str], order: list[str], value: str, high: float, low: float, t: str = "t", merge_s: float = 1.2, least_s: float = 2.0) -> DataFrame:
    """Segments that begin above high and end below low: keys..., a, b (times of the first and last row).

    A segment is carried back over the rows above low before it; those closer than merge_s are one; shorter ones than
    least_s are dropped. The state of a row is that of the last row beyond either threshold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    said = F.when(F.col(value) > high, 1).when(F.col(value) < low, 0)
    state = F.coalesce(F.last(said, ignorenulls=True).over(w), F.lit(0))
    # the row that falls below low still belongs to its segment: off begins on the row after
    on = df.withColumn("__s", state).withColumn("__on", (F.col("__s") == 1) | (F.lag("__s", 1, 0).over(w) == 1))
    on = on.withColumn("__on", F.when((F.col("__s") == 1) & (F.lag("__s", 1, 0).over(w) == 0), F.lit(2)).otherwise(F.col("__on").cast("int")))
    # back-extension: rows above low that run up to a segment's start without a break
    back = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    above = F.col(value) > low
    broken = on.withColumn("__stop", F.sum(F.when(~above | (F.col("__on") > 0), 1).otherwise(0)).over(back))
    lead_on = F.last(F.when((F.col("__on") > 0) | ~above, F.col("__on")), ignorenulls=True).over(back)
    ext = broken.withColumn("__in", (F.col("__on") > 0) | (above & (lead_on == 2)))
    starts = F.when(F.col("__in") & (~F.lag("__in", 1, False).over(w) | ((F.col("__on") == 2) & (F.lag("__on", 1, 0).over(w) > 0))), 1).otherwise(0)
    numbered = ext.withColumn("__k", F.sum(starts).over(w)).filter("__in")
    segments = numbered.groupBy(*keys, "__k").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    by = Window.partitionBy(*keys).orderBy("a")
    joined = segments.withColumn("__g", F.sum(F.when(F.col("a") - F.lag("b").over(by) < merge_s, 0).otherwise(1)).over(by))
    return joined.groupBy(*keys, "__g").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter(F.col("b") - F.col("a") >= least_s).drop("__g")
