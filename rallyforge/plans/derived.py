"""Tables that are not shipped, made by whole-number arithmetic so that SQL can make the same.

positions_of_events: positions made from the event stream, in turn a serve stance, play and rest. They hold more serve
events, sessions and scores than recorded positions do: a fixture for tests; no query reads them.
identity_tables: what a picture model would have said about the detection behind each reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions_of_events(events: DataFrame) -> DataFrame:
    """game_id, clip, player, frame, t, x, y, speed, dist_t in 16 games; a 31st of the places is missing."""
    game = F.floor(F.col("user_id") / 2) % 16
    by = Window.partitionBy("g", "player").orderBy("ts", "event_id")
    rows = events.select("ts", "event_id", "user_id", game.alias("g"), F.when(F.col("user_id") % 2 == 0, "p1").otherwise("p2").alias("player"))
    rows = rows.withColumn("frame", (F.row_number().over(by) - 1).cast("bigint")).withColumn("block", F.floor(F.col("frame") / 120)).withColumn("phase", F.col("frame") % 120)
    block = Window.partitionBy("g", "block")
    server = F.when(F.sum("user_id").over(block) % 2 == 0, "p1").otherwise("p2")
    left = F.sum("event_id").over(block) % 3 == 0
    rows = rows.withColumn("server", server).withColumn("left", left)
    serves = F.col("player") == F.col("server")
    wave = lambda a, period: F.abs((a * F.col("frame") + F.col("user_id")) % period - period // 2) / F.lit(100.0)
    stance = F.when(serves, F.when(F.col("left"), 0.8).otherwise(5.6)).otherwise(F.when(F.col("left"), 4.5).otherwise(1.9))
    x = F.when(F.col("phase") >= 100, F.lit(3.2)).when(F.col("phase") >= 30, wave(17, 1280)).otherwise(stance)
    y = F.when(F.col("phase") >= 100, F.lit(8.0)).when(F.col("phase") >= 30, wave(29, 1950)).otherwise(F.lit(6.2))
    there = F.col("event_id") % 31 != 0
    spots = rows.select(
        F.format_string("ev%02d", "g").alias("game_id"), F.lit(0).alias("clip"), "player", "frame", (F.col("frame") / F.lit(10.0)).alias("t"), F.when(there, x).alias("x"), F.when(there, y).alias("y")
    )
    w = Window.partitionBy("game_id", "clip", "player").orderBy("frame")
    across = lambda c: (F.lead(c).over(w) - F.lag(c).over(w))
    speed = F.round(F.sqrt(across("x") * across("x") + across("y") * across("y")) / F.lit(0.2), 4)
    dx, dy = F.col("x") - 3.2, F.col("y") - 5.44
    return spots.withColumn("speed", speed).withColumn("dist_t", F.round(F.sqrt(dx * dx + dy * dy), 4))


def identity_tables(pos: DataFrame, in_place: bool = False) -> dict[str, DataFrame]:
    """detections, patches, appearance, cnn, tracklets, labels, probs, joined by game_id, clip, det_id (labels by tracklet);
    each lacks some detections, and some numbers are missing. in_place: the few numbers that they are made from are shuffled by
    detection first, so that joins by detection find the wide rows where they are made."""
    one = F.col("player") == "p1"
    k = F.col("frame") * 7 + F.col("clip") * 3 + F.when(one, 0).otherwise(5)
    side = F.when(one, 0).otherwise(1)
    rows = pos.filter(F.col("player").isin("p1", "p2")).select("game_id", "clip", (F.col("frame") * 2 + side).alias("det_id"), "frame", "t", "conf", k.alias("k"), side.alias("side"))
    key = ["game_id", "clip", "det_id"]
    tracklet_of = lambda: F.floor(F.col("frame") / 40) * 2 + F.col("side")
    mod = lambda a, m: (F.col("k") * a % m).cast("double")
    thigh = lambda a, n: [F.when(F.col("k") % n != 0, mod(a + i, m)).alias(c) for i, (c, m) in enumerate((("h", 180), ("s", 97), ("v", 89)))]
    marked = rows.filter("k % 7 <> 0").select("game_id", "clip", tracklet_of().alias("tracklet")).distinct().filter("tracklet % 3 <> 2")
    rows = rows.repartition(*key) if in_place else rows
    left, right = F.struct(*thigh(3, 4)).alias("l"), F.struct(*thigh(17, 6)).alias("r")
    patches = rows.filter("k % 9 <> 0").select(*key, mod(13, 180).alias("chest_h"), (mod(5, 97) + (1 - F.col("side")) * 60).alias("chest_s"), mod(11, 89).alias("chest_v"), left, right)
    patches = patches.select(*key, "chest_h", "chest_s", "chest_v", *(F.col(f"{x}.{c}").alias(f"{x}th_{c}") for x in "lr" for c in "hsv"))
    described = F.transform(F.sequence(F.lit(0), F.lit(27)), lambda i: (F.col("k") * (i + 3) % 83) / F.lit(83.0))
    linked = rows.filter("k % 7 <> 0").select(*key, tracklet_of().alias("tracklet"))
    label = F.when(F.col("tracklet") % 5 == 0, "other").when(F.col("tracklet") % 2 == 0, "p1").otherwise("P2 ")
    return {
        "detections": rows.select(*key, "frame", "t", "conf"), "patches": patches,
        "appearance": rows.filter("k % 8 <> 0").select(*key, described.alias("d"), mod(19, 61).alias("shirt_v"), mod(23, 67).alias("shorts_s"), mod(29, 71).alias("shorts_v")),
        "cnn": rows.filter("k % 5 <> 0").select(*key, F.array(*(mod(a, 53) / 53 for a in (7, 11, 13, 17))).alias("embedding")),
        "tracklets": linked, "labels": marked.withColumn("label", label),
        "probs": rows.filter("k % 10 <> 0").select(*key, (mod(29, 101) / 101).alias("prob_p1"), (mod(37, 59) / 118).alias("prob_p2"), (mod(31, 53) / 90).alias("prob_other")),
    }
