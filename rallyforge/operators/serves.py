"""Serve events, their clusters (sessions) and the running score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.functions import court
from rallyforge.operators.islands import runs
from rallyforge.operators.signals import CLIP


def serving(pad: float | Column = 0.35, rule: str = "opposite_half") -> Column:
    """struct(server, box, cost) of a frame, NULL if nobody serves. The cheaper of the two readings of the frame counts
    (p1 on a tie). Needs x1 ... v2 and the threshold slow."""

    def reading(s: str, r: str) -> Column:
        xs, ys, vs = (F.col(c + s) for c in "xyv")
        xr, yr, vr = (F.col(c + r) for c in "xyv")
        box = court.box_of(xs, ys, pad)
        ok = box.isNotNull() & court.receiver_ok(xr, yr, box, rule) & (vs < F.col("slow")) & (vr < 4.0) & xs.isNotNull() & xr.isNotNull()
        return F.when(ok, F.struct(F.lit(f"p{s}").alias("server"), box.alias("box"), (vs + 0.2 * vr).alias("cost")))

    one, two = reading("1", "2"), reading("2", "1")
    return F.when(one.isNull(), two).when(two.isNull(), one).when(two["cost"] < one["cost"], two).otherwise(one)


def serve_events(wide: DataFrame, thresholds: DataFrame, rule: str = "opposite_half") -> DataFrame:
    """game_id, clip, server, box, t0, t1: runs of frames with one server that last long enough; the box is the most
    frequent one of the run (left on a tie)."""
    seen = wide.join(thresholds.select(*CLIP, "slow", "serve_min_s"), CLIP).withColumn("s", serving(rule=rule))
    found = runs(
        seen, CLIP, ["frame"], F.col("s.server"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.mode("s.box", deterministic=True).alias("box"), F.max("serve_min_s").alias("least")
    )
    return found.filter("t1 - t0 >= least").select(*CLIP, F.col("state").alias("server"), "box", "t0", "t1")


def serve_clusters(events: DataFrame, gap_s: float = 3.0) -> DataFrame:
    """game_id, clip, t0, t1, server, box, ambiguous. An event closer than gap_s to the one before joins its cluster; the
    heaviest (server, box) names it (weight: duration + 0.2 of each event; a tie goes to the earlier one), and it is
    ambiguous when the second is not clearly lighter."""
    by = Window.partitionBy(*CLIP).orderBy("t0", "t1", "server")
    started = events.withColumn("new", F.when(F.col("t0") - F.lag("t1").over(by) < gap_s, 0).otherwise(1))
    numbered = started.withColumn("cluster", F.sum("new").over(by))
    weights = numbered.groupBy(*CLIP, "cluster", "server", "box").agg(
        F.sum(F.col("t1") - F.col("t0") + 0.2).alias("w"), F.min("t0").alias("a"), F.max_by("t1", "t0").alias("b")
    )
    whole = Window.partitionBy(*CLIP, "cluster")
    # by weight; weights that agree to a millionth are ties, which the earlier one wins
    rank = whole.orderBy(F.round("w", 6).desc(), "a")
    ranked = weights.withColumn("r", F.row_number().over(rank)).withColumn("second", F.lead("w").over(rank))
    ranked = ranked.withColumn("t0", F.min("a").over(whole)).withColumn("t1", F.max("b").over(whole))
    ambiguous = F.coalesce(F.round("w", 6) < F.round(1.5 * F.col("second"), 6), F.lit(False))
    return ranked.filter("r = 1").select(*CLIP, "t0", "t1", "server", "box", ambiguous.alias("ambiguous"))


#: Fixed value: the note of a let, as it is counted (a review lists any note with "let" in it).
LET_COUNTED = "let (same"
LET = f"{LET_COUNTED} server, same box)"


def score(rallies: DataFrame, order: str = "t_start", keys: list[str] = CLIP, game_ball: int = 15) -> DataFrame:
    """Adds winner, score_p1, score_p2, score_note. The winner of a rally serves the next one; the same server from the
    same box is a let; the last rally of a clip is decided only when exactly one side stands one point before the end."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    there, next_server, next_box = F.lead(F.lit(1)).over(w), F.lead("server").over(w), F.lead("box").over(w)
    let = (next_server == F.col("server")) & next_box.eqNullSafe(F.col("box"))
    known = rallies.withColumn("__w", F.when(F.col("server").isNotNull() & there.isNotNull() & ~F.coalesce(let, F.lit(False)), next_server)).withColumn("__last", there.isNull()).withColumn("__let", let)
    before = {p: F.coalesce(F.sum((F.col("__w") == p).cast("int")).over(upto), F.lit(0)) for p in ("p1", "p2")}
    known = known.withColumn("__a", before["p1"]).withColumn("__b", before["p2"])
    edge = game_ball - 1
    last = F.when((F.col("__a") == edge) & (F.col("__b") < edge), "p1").when((F.col("__b") == edge) & (F.col("__a") < edge), "p2")
    winner = F.when(F.col("__last") & F.col("server").isNotNull(), last).otherwise(F.col("__w"))
    note = (
        F.when(F.col("server").isNull(), "no serve seen").when(winner.isNotNull(), "").when(F.col("__last"), "last rally: winner unknown")
        .when(F.coalesce("__let", F.lit(False)), LET).otherwise("next serve not seen: winner unknown")
    )
    scored = known.withColumn("winner", winner).withColumn("score_note", note)
    run = lambda p: F.sum(F.coalesce((F.col("winner") == p).cast("bigint"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return scored.withColumn("score_p1", run("p1")).withColumn("score_p2", run("p2")).drop("__w", "__last", "__let", "__a", "__b")


def rest_before(order: str = "t_start", keys: list[str] = CLIP) -> Column:
    w = Window.partitionBy(*keys).orderBy(order)
    return F.col("t_start") - F.lag("t_end").over(w)
