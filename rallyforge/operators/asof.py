"""As-of and interval lookups between readings and rallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.signals import CLIP
from rallyforge.session import lookup


def with_last(frames: DataFrame, marks: DataFrame, at: str, strictly: bool = False) -> DataFrame:
    """Frames (with t) with the columns of the last mark of their clip at or before them (strictly: before them); frames
    without one are left out. Union and one window over the clip; no pair of a frame and a mark is ever formed."""
    columns = [c for c in marks.columns if c not in CLIP]
    mark = marks.select(*CLIP, F.col(at).cast("double").alias("t"), F.lit(1 if strictly else 0).alias("__k"), F.struct(*columns).alias("__m"))
    rows = frames.filter("t IS NOT NULL").withColumn("__k", F.lit(0 if strictly else 1)).withColumn("__m", F.lit(None).cast(mark.schema["__m"].dataType))
    w = Window.partitionBy(*CLIP).orderBy("t", "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(mark, allowMissingColumns=True).withColumn("__last", F.last("__m", ignorenulls=True).over(w))
    kept = both.filter(F.col("__m").isNull() & F.col("__last").isNotNull())
    return kept.select(*(c for c in frames.columns if c not in columns), *(F.col(f"__last.{c}").alias(c) for c in columns))


def score_at(frames: DataFrame, rallies: DataFrame) -> DataFrame:
    """Adds score_p1, score_p2: those of the last rally that ended at or before the frame, else 0. Union and one window over
    the clip; no pair of a frame and a rally is ever formed."""
    marks = rallies.select(*CLIP, F.col("t_end").alias("t"), F.lit(0).alias("__k"), F.struct("score_p1", "score_p2").alias("__s"))
    rows = frames.filter("t IS NOT NULL").withColumn("__k", F.lit(1)).withColumn("__s", F.lit(None).cast(marks.schema["__s"].dataType))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*CLIP).orderBy("t", "__k", "__s.score_p1", "__s.score_p2").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("__s", ignorenulls=True).over(w)
    named = both.withColumn("score_p1", F.coalesce(last["score_p1"], F.lit(0))).withColumn("score_p2", F.coalesce(last["score_p2"], F.lit(0)))
    return named.filter("__k = 1").drop("__k", "__s")


def rally_at(frames: DataFrame, rallies: DataFrame) -> DataFrame:
    """Adds rally: the first rally that the frame lies in (ends included), else NULL."""
    r = rallies.select(*CLIP, "rally", "t_start", "t_end")
    hits = frames.select(*CLIP, "frame", "t").join(r, CLIP).filter("t >= t_start AND t <= t_end").groupBy(*CLIP, "frame").agg(F.min("rally").alias("rally"))
    return frames.join(hits, [*CLIP, "frame"], "left")


def near_rallies(frames: DataFrame, rallies: DataFrame, pad_s: float = 1.0) -> DataFrame:
    """The frames within pad_s of a rally (semi-join)."""
    f, r = frames.alias("f"), rallies.select(*CLIP, "t_start", "t_end").alias("r")
    on = (F.col("f.game_id") == F.col("r.game_id")) & (F.col("f.clip") == F.col("r.clip"))
    return f.join(r, on & (F.col("f.t") >= F.col("r.t_start") - pad_s) & (F.col("f.t") <= F.col("r.t_end") + pad_s), "left_semi")


#: Reasons to look at a rally, in their order; for a game with a user from that player's side, else from both.
LONGEST, LOST_RUNNING, WON_AT_T, MADE_TO_RUN, LET = "longest rally", "lost after much running", "won while holding the T", "opponent made to run", "let"


def review(rallies: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Rallies worth a look, each once with the first of its reasons: game_id, clip, rally, seq, reason, player (whom it concerns;
    NULL for the longest rally and lets). users: game_id, user_player. With a user: the longest rally, the two lost with most
    running, the two won with most of the T, the one won in which the opponent ran most, lets. Without: the longest, for each
    player the two lost and the one won, lets. Missing ways and shares come last, ties go to the earlier rally."""
    named = rallies if users is None else lookup(rallies, users.groupBy("game_id").agg(F.min("user_player").alias("__user")), ["game_id"])
    user = F.lit(None).cast("string") if users is None else F.when(F.col("__user").isin("p1", "p2"), F.col("__user"))
    rows = named.withColumn("__user", user).select(*CLIP, "rally", "duration", "winner", "note", "dist_p1", "dist_p2", "tshare_p1", "tshare_p2", "__user")
    sides = rows.withColumn("player", F.explode(F.when(F.col("__user").isNull(), F.array(F.lit("p1"), F.lit("p2"))).otherwise(F.array("__user"))))
    first = F.col("player") == "p1"
    of = lambda c, other=False: F.when(first != F.lit(other), F.col(f"{c}_p1")).otherwise(F.col(f"{c}_p2"))
    won = F.col("winner") == F.col("player")
    lists = [  # number in the order of reasons, which rallies, by what, how many with and without a user
        (1, LOST_RUNNING, F.col("winner").isNotNull() & ~won, of("dist"), 2, 2), (2, WON_AT_T, won, of("tshare"), 2, 1), (3, MADE_TO_RUN, won, of("dist", True), 1, 0),
    ]
    found = []
    for no, why, which, by, k_user, k_both in lists:
        w = Window.partitionBy(*CLIP, "player").orderBy(F.col("__by").desc_nulls_last(), "rally")
        ranked = sides.filter(which).withColumn("__by", by).withColumn("__r", F.row_number().over(w))
        kept = ranked.filter(F.col("__r") <= F.when(F.col("__user").isNotNull(), k_user).otherwise(k_both))
        seq = F.lit(no) + F.when(F.col("player") == "p2", 10).otherwise(0)
        found.append(kept.select(*CLIP, "rally", seq.alias("seq"), F.lit(why).alias("reason"), "player"))
    none = F.lit(None).cast("string").alias("player")
    w = Window.partitionBy(*CLIP).orderBy(F.col("duration").desc_nulls_last(), "rally")
    longest = rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1 AND duration IS NOT NULL")
    found.append(longest.select(*CLIP, "rally", F.lit(0).alias("seq"), F.lit(LONGEST).alias("reason"), none))
    found.append(rows.filter(F.col("note").contains("let")).select(*CLIP, "rally", F.lit(99).alias("seq"), F.lit(LET).alias("reason"), none))
    return reduce(DataFrame.unionByName, found).groupBy(*CLIP, "rally").agg(F.min(F.struct("seq", "reason", "player")).alias("m")).select(*CLIP, "rally", "m.*")
