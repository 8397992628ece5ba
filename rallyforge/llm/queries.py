"""Queries of the llm operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyforge.llm import encode, mix, percentiles, pieces, runs, splits
from rallyforge.session import sized, stored
from rallyforge.sources.tables import table

#: Rows of small results (one for each limit; for each player, metric and percentile) that are broadcast; percentiles beyond
#: it are joined by shuffle.
MOST_FOUND = 100_000


def p1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "positions"), table(spark, sf_dir, "games"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse_runs(table(spark, sf_dir, "positions"), table(spark, sf_dir, "games"), least_rows=4)
    return found.select("game_id", "clip", "player", "frame_first", "frame_last")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = splits.tie_components(table(spark, sf_dir, "tracklets_tmp"))
    return roots.select("game_id", roots["root"].alias("tracklet_a"), roots["tracklet"].alias("tracklet_b"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_splits(table(spark, sf_dir, "tracklets_tmp"), table(spark, sf_dir, "split_targets"))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shares(p3_splits(spark, sf_dir), table(spark, sf_dir, "split_targets"))


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.percentiles(table(spark, sf_dir, "positions"))


def p5_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One combinable summary for each day, game, player and metric."""
    return percentiles.summaries(table(spark, sf_dir, "positions"), ["day", "game_id", "player"])


def p5_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per player out of the summaries of all days and games."""
    return percentiles.of_summary(percentiles.combine(p5_summaries(spark, sf_dir), ["player"]), ["player"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mix.mix(mix.sized_records(table(spark, sf_dir, "documents"), targets, drawn_only=True), targets)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    sized = mix.sized_records(table(spark, sf_dir, "documents"), targets)
    return mix.shares(sized, mix.mix(sized, targets), targets)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.cut(table(spark, sf_dir, "documents"), table(spark, sf_dir, "piece_limits"))


# -- what must hold of results that SQL cannot give: each query counts its violations over all rows


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct detections, tracklets with detections in several splits, and whether every share is within a hundredth."""
    tracklets = table(spark, sf_dir, "tracklets_tmp")
    assigned = stored(p3_splits(spark, sf_dir))
    linked = tracklets.filter("det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1").join(assigned, ["game_id", "det_id"])
    parted = linked.groupBy("game_id", "tracklet").agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("parted_tracklets"))
    near = splits.shares(assigned, table(spark, sf_dir, "split_targets")).agg(F.sum("n").alias("records"), F.max(F.abs(F.col("share") - F.col("target"))).alias("off"))
    return near.join(F.broadcast(parted)).select("records", "parted_tracklets", (F.col("off") < 0.01).alias("near"))  # one row each


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each combined percentile whether its rank is within the bound that it states."""
    found = stored(p5_combined(spark, sf_dir))
    values = percentiles.long_values(percentiles.counted_values(table(spark, sf_dir, "positions")), ["player"])
    f, v = sized(found, MOST_FOUND).alias("f"), values.alias("v")  # one row for each player, metric and percentile
    both = v.join(f, (F.col("v.player") == F.col("f.player")) & (F.col("v.metric") == F.col("f.metric")))
    count = lambda c: F.sum(c.cast("bigint"))
    ranks = both.groupBy("f.player", "f.metric", "f.q", "f.n", "f.rank_error").agg(count(F.col("v.value") < F.col("f.value")).alias("below"), count(F.col("v.value") <= F.col("f.value")).alias("upto"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n")))
    return ranks.select("player", "metric", "q", "n", ((wanted >= F.col("below") + 1 - F.col("rank_error")) & (wanted <= F.col("upto") + F.col("rank_error"))).alias("within"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each wanted source whether a record occurs too often, and whether its tokens are its share of all, to a record or two."""
    targets = table(spark, sf_dir, "mix_targets")
    sized = mix.sized_records(table(spark, sf_dir, "documents"), targets)
    mixed = stored(mix.mix(sized, targets))
    repeats = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("k"))
    longest = mixed.agg(F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("whole"))
    shares = mix.shares(sized, mixed, targets).join(repeats, "source", "left").join(F.broadcast(longest))  # one row
    off = F.abs(F.col("mix_tokens") - F.col("target_share") * F.coalesce("whole", F.lit(0)))
    return shares.select("source", (F.coalesce("k", F.lit(0)) > F.col("max_repeats")).alias("over_repeated"), (off <= 2 * F.coalesce("longest", F.lit(0)) + F.col("whole") / mix.MOST_SLOTS).alias("in_share"))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each limit the pieces beyond it, the pieces that do not go on where the one before ended or share too little with it,
    and the texts whose end is missing."""
    limits = table(spark, sf_dir, "piece_limits")
    got = p8_pieces(spark, sf_dir).select("doc_id", "limit_name", "piece_no", "n_tokens", "overlap", "token_start", "cut")
    w = Window.partitionBy("doc_id", "limit_name").orderBy("piece_no")
    ends = got.withColumn("before", F.coalesce(F.lag(F.col("token_start") + F.col("n_tokens")).over(w), F.lit(0))).withColumn("last", F.lead("piece_no").over(w).isNull())
    rows = ends.join(F.broadcast(limits.distinct().limit(MOST_FOUND)), "limit_name")
    little = (F.col("token_start") > 0) & (F.col("overlap") < F.least(F.coalesce("overlap_tokens", F.lit(0)), F.col("max_tokens") - 1 - pieces.SLACK))
    bad = F.struct(
        (F.col("n_tokens") > F.col("max_tokens")).alias("over"), ((F.col("token_start") + F.col("overlap") != F.col("before")) | little).alias("gap"), (F.col("last") != (F.col("cut") == "end")).alias("open"),
    )
    counted = rows.withColumn("bad", bad).groupBy("limit_name").agg(*(F.sum(F.col(f"bad.{c}").cast("bigint")).alias(n) for c, n in (("over", "over_limit"), ("gap", "gaps"), ("open", "unfinished"))))
    return limits.select("limit_name").distinct().join(counted, "limit_name", "left").na.fill(0)


def queries() -> dict:
    return {"p7_mix": p7_mix, "p7_shares": p7_shares, "p8_pieces": p8_pieces, "p3_found": p3_found, "p3_splits": p3_splits, "p3_shares": p3_shares, "p5_percentiles": p5_percentiles, "p5_summaries": p5_summaries, "p5_combined": p5_combined, "p6_ids": p6_ids, "p1_found": p1_found, "p1_runs": p1_runs, "p3_checks": p3_checks, "p5_checks": p5_checks, "p7_checks": p7_checks, "p8_checks": p8_checks}
