"""Metrics of players and games from positions and rallies.

Rows inside rallies come from an interval join: the key game_id, clip makes it a hash join, and the rallies (some tens a
clip) are the small side. Statistics over a whole recording run over its rows inside rallies one after the other, so a
step or an excursion may reach from one rally into the next; per-rally columns do not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.functions import court
from rallyforge.operators import islands
from rallyforge.operators.serves import LET_COUNTED
from rallyforge.operators.signals import CLIP

WHO = [*CLIP, "player"]
GRID = 0.25


def share(condition: Column) -> Column:
    """Share of all rows; an unknown condition does not hold, but its row counts."""
    return F.avg(F.coalesce(condition.cast("int"), F.lit(0)))


def share_known(condition: Column) -> Column:
    """Share of the rows where the condition is known."""
    return F.avg(condition.cast("int"))


def rows_in_rallies(wide: DataFrame, rallies: DataFrame) -> DataFrame:
    """Frames inside a rally (ends included) with its number; of overlapping rallies the last."""
    r = rallies.select(*CLIP, "rally", "t_start", "t_end")
    hits = wide.join(r, CLIP).filter("t >= t_start AND t <= t_end")
    return hits.groupBy(*CLIP, "frame").agg(F.max("rally").alias("rally"), *(F.first(c).alias(c) for c in wide.columns if c not in (*CLIP, "frame")))


def by_player(inside: DataFrame) -> DataFrame:
    """One row per player and frame: x, y, speed, dist_t of the player, ox ... of the opponent."""
    one = F.struct(F.lit("p1").alias("player"), *(F.col(c + "1").alias(n) for c, n in zip("xyvd", ("x", "y", "speed", "dist_t"))), *(F.col(c + "2").alias("o" + c) for c in "xyd"))
    two = F.struct(F.lit("p2").alias("player"), *(F.col(c + "2").alias(n) for c, n in zip("xyvd", ("x", "y", "speed", "dist_t"))), *(F.col(c + "1").alias("o" + c) for c in "xyd"))
    return inside.select(*CLIP, "frame", "t", "rally", F.inline(F.array(one, two)))


def movement(rows: DataFrame, left_handed: tuple[str, ...] = ()) -> DataFrame:
    """Per player of a clip: presence, T control, zones, sides, distance, speed. left_handed: the players whose forehand is
    on the left."""
    x, y, d = F.col("x"), F.col("y"), F.col("dist_t")
    there = F.when(x.isNotNull(), True)
    row, col = court.zone_row(y), court.zone_col(x)
    w = Window.partitionBy(*WHO).orderBy("frame")
    step = F.coalesce(F.hypot(x - F.lag("x").over(w), y - F.lag("y").over(w)), F.lit(0.0))
    both = x.isNotNull() & F.col("od").isNotNull()
    fore = F.when(F.col("player").isin(*left_handed), 0).otherwise(1) if left_handed else F.lit(1)
    return rows.withColumn("step", step).groupBy(*WHO).agg(
        F.count("x").alias("frames_in_rally"), share(there).alias("tracked_share"), share(d < 1.0).alias("t_share_1m"), share(d < 1.5).alias("t_share_1_5m"),
        F.avg(F.when(both, F.coalesce((d < F.col("od")).cast("int"), F.lit(0)))).alias("closer_to_t_share"), F.avg("dist_t").alias("mean_dist_t"), F.median("dist_t").alias("median_dist_t"),
        share_known(row == 0).alias("front_share"), share_known(row == 1).alias("mid_share"), share_known(row == 2).alias("back_share"),
        share_known(col == 0).alias("left_share"), share_known(col == 1).alias("right_share"),
        share_known(col == fore).alias("forehand_side_share"), share_known(col != fore).alias("backhand_side_share"),
        F.avg(F.when(both & (F.col("od") < 1.0), (y > court.BACK_START).cast("int"))).alias("back_when_opponent_at_t"),
        F.sum("step").alias("distance_rally_m"), F.avg("speed").alias("mean_speed"), F.percentile("speed", F.lit(0.99)).alias("peak_speed"),
    )


def zone_shares(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., zone, n, share of the tracked rows, for every zone that occurs."""
    tracked = rows.withColumn("zone", court.zone_name(F.col("x"), F.col("y"))).filter("zone IS NOT NULL")
    counted = tracked.groupBy(*keys, "zone").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def bin_of(v: Column, size: float, most: int) -> Column:
    """Bin number; the last bin includes its upper end."""
    return F.least(F.floor(v / size), F.lit(most)).cast("bigint")


def heatmap(rows: DataFrame, keys: list[str], size: float = GRID) -> DataFrame:
    """keys..., yb, xb, n: the court in squares (39 by 26 of 0.25 m), the lines on its far sides in the last square."""
    inside = rows.filter((F.col("x") >= 0) & (F.col("x") <= 6.5) & (F.col("y") >= 0) & (F.col("y") <= court.LENGTH))
    return inside.groupBy(*keys, bin_of(F.col("y"), size, 38).alias("yb"), bin_of(F.col("x"), size, 25).alias("xb")).agg(F.count("*").alias("n"))


def speed_histogram(rows: DataFrame, keys: list[str], size: float = GRID, top: float = 6.25) -> DataFrame:
    """keys..., bin, n, density; speeds beyond the top do not count."""
    inside = rows.filter((F.col("speed") >= 0) & (F.col("speed") <= top))
    counted = inside.groupBy(*keys, bin_of(F.col("speed"), size, round(top / size) - 1).alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(*keys)) * size))


def points(rallies: DataFrame) -> DataFrame:
    """Per player of a clip: points won and lost, served, received, won on each, mean lengths, mean ways."""
    player = F.explode(F.array(F.lit("p1"), F.lit("p2")))
    r = rallies.withColumn("player", player)
    won, lost = F.col("winner") == F.col("player"), F.col("winner") != F.col("player")
    served, received = F.col("server") == F.col("player"), F.col("server") != F.col("player")
    count = lambda c: F.sum(F.coalesce(c.cast("bigint"), F.lit(0)))
    way = F.when(F.col("player") == "p1", F.col("dist_p1")).otherwise(F.col("dist_p2"))
    return r.groupBy(*WHO).agg(
        count(won).alias("points_won"), count(lost).alias("points_lost"), count(served).alias("rallies_served"), count(served & won).alias("points_won_on_serve"),
        count(received).alias("rallies_received"), count(received & won).alias("points_won_on_receive"),
        F.avg(F.when(won, F.col("duration"))).alias("mean_rally_won_s"), F.avg(F.when(lost, F.col("duration"))).alias("mean_rally_lost_s"),
        F.avg(way).alias("distance_per_rally_m"), F.avg(F.when(won, way)).alias("distance_won_m"), F.avg(F.when(lost, way)).alias("distance_lost_m"),
    )


def serve_by_box(rallies: DataFrame) -> DataFrame:
    r = rallies.filter("server IS NOT NULL AND box IS NOT NULL")
    return r.groupBy(*CLIP, "server", "box").agg(F.count("*").alias("served"), F.sum(F.coalesce((F.col("winner") == F.col("server")).cast("bigint"), F.lit(0))).alias("won"))


def longest_streaks(rallies: DataFrame) -> DataFrame:
    """game_id, clip, player, longest_run: the longest series of points; an undecided rally ends a series."""
    runs = islands.longest_run(rallies, CLIP, ["rally"], F.col("winner"))
    return runs.select(*CLIP, F.col("state").alias("player"), F.col("longest").alias("longest_run"))


def game_summary(rallies: DataFrame) -> DataFrame:
    """One row per clip: counts, lengths, rest, the longest rally (the first of equals), final score."""
    let = F.coalesce(F.col("note").contains(LET_COUNTED), F.lit(False))
    w = Window.partitionBy(*CLIP).orderBy("rally")
    alternates = F.when((F.lead("server").over(w) == F.col("server")) & (F.col("winner") == F.col("server")), F.coalesce((F.lead("box").over(w) != F.col("box")).cast("int"), F.lit(0)))
    r = rallies.withColumn("__alt", alternates)
    total = F.sum("duration")
    rest = F.sum("rest_before")
    return r.groupBy(*CLIP).agg(
        F.min("t_start").alias("t_first"), F.max("t_end").alias("t_last"), F.count("*").alias("n_rallies"), F.count("winner").alias("n_points"),
        F.sum(let.cast("bigint")).alias("n_lets"), F.sum((F.col("winner").isNull() & ~let).cast("bigint")).alias("n_unknown"),
        F.avg("duration").alias("mean_rally_s"), F.median("duration").alias("median_rally_s"), F.max("duration").alias("longest_rally_s"),
        F.max_by("rally", F.struct("duration", -F.col("rally"))).alias("longest_rally_no"), total.alias("total_rally_s"), F.coalesce(rest, F.lit(0.0)).alias("total_rest_s"),
        F.avg("rest_before").alias("mean_rest_s"), F.when(rest > 0, total / rest).alias("work_rest_ratio"),
        F.max_by("score_p1", "rally").alias("final_p1"), F.max_by("score_p2", "rally").alias("final_p2"),
        F.coalesce(F.sum("__alt"), F.lit(0)).alias("alternations_ok"), F.count("__alt").alias("alternations"),
    )


def separation(inside: DataFrame) -> DataFrame:
    """Per clip: mean distance of the players, share of all frames closer than a metre."""
    apart = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    return inside.withColumn("apart", apart).groupBy(*CLIP).agg(F.avg("apart").alias("mean_separation_m"), share(F.col("apart") < 1.0).alias("crowding_share"))


def reliability(pos: DataFrame, inside: DataFrame, rates: DataFrame) -> DataFrame:
    """Per player (p1, p2) of a clip with rallies: frames in rallies, the shares of them where the player is tracked, with
    cut-off feet and interpolated (a frame without a row of the player has none of these), readings a second."""
    frames = inside.select(*CLIP, "frame", F.explode(F.array(F.lit("p1"), F.lit("p2"))).alias("player"))
    rows = frames.join(pos.select(*WHO, "frame", "x", "feet_cut", "interpolated"), [*WHO, "frame"], "left")
    made = rows.groupBy(*WHO).agg(
        F.count("*").alias("n"), share(F.col("feet_cut")).alias("feet_cut_share"), share(F.col("interpolated")).alias("interpolated_share"), share(F.col("x").isNotNull()).alias("tracked_share")
    )
    return made.join(rates.select(*CLIP, F.rint("fps_eff").cast("bigint").alias("samples_per_s")), CLIP, "left")
