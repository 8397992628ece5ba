"""Problem 3: splits that keep related records together.

1. Components. Two tracklets of a game are tied when a detection is linked to both. Ties come from an aggregation per
   detection (each of its tracklets to its least one, so a detection with very many tracklets gives no pairs), and
   components from alternating large-star and small-star steps: minima by map-side aggregation, joins that adaptive
   execution splits where a tracklet is hot, each round written to the checkpoint folder. No component is gathered.
2. Equal bins by largest differencing. Components are spread over groups of bounded size; in a group, every component
   starts as a partition of one full and BINS - 1 empty bins, and again and again the two partitions with the largest
   difference are combined, the largest bin of one with the smallest of the other. The groups' bins are then combined
   with each other in the same way, ``FAN_IN`` groups at a time, until BINS bins are left. Components of one record
   need no queue: they fill the lowest bins, which is what differencing does with them.
3. Whole bins go to splits, the largest first, each to the split that is furthest below its target. Only BINS sums
   reach the driver.

Defined results: NULL det_id is no record; NULL or -1 as tracklet is no link; a detection listed both as linked and as
not linked is linked; copies count once; a detection without link stands for itself. Shares are taken relative to
their sum; NULL or negative shares count as 0; if all are 0, every split gets the same. A component larger than a bin
makes that bin larger. Empty input gives no rows. Equal input gives equal splits, whatever the partitioning.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyforge.session import cut_lineage, sized, stored

BINS, GROUP_ROWS, FAN_IN, MOST_ROUNDS = 200, 50_000, 256, 100


def detections(tracklets: DataFrame) -> DataFrame:
    """game_id, det_id, low, high: each detection with its least and greatest tracklet (NULL where it is linked to none).
    Copies do no harm to either, so nothing has to be made distinct."""
    valid = F.when(F.col("tracklet") != -1, F.col("tracklet"))
    return tracklets.filter("det_id IS NOT NULL").groupBy("game_id", "det_id").agg(F.min(valid).alias("low"), F.max(valid).alias("high"))


def tie_components(tracklets: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """game_id, tracklet, root for each tracklet of a group of two or more that is not its least one (root). records: the
    detections of tracklets, if they are there already."""
    records = detections(tracklets) if records is None else records
    tied = cut_lineage(records.filter("low < high").select("game_id", "det_id", "low"))
    rows = tracklets.filter("det_id IS NOT NULL AND tracklet IS NOT NULL AND tracklet <> -1")
    a, b = rows.alias("a"), sized(tied).alias("b")
    same = F.col("a.game_id").eqNullSafe(F.col("b.game_id")) & (F.col("a.det_id") == F.col("b.det_id"))
    edges = a.join(b, same).filter("a.tracklet > b.low").select("a.game_id", F.col("a.tracklet").alias("u"), F.col("b.low").alias("v")).distinct()
    edges = cut_lineage(edges)
    state = None
    for _ in range(MOST_ROUNDS):
        edges = cut_lineage(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("game_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("game_id", F.col("u").alias("tracklet"), F.col("v").alias("root"))
        state = now
    raise RuntimeError("components did not settle")


def _pair(u: str, v: str):
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least neighbour of u, or u itself if that is less."""
    least = pairs.groupBy("game_id", "u").agg(F.min("v").alias("m"))
    p, q = pairs.alias("p"), least.alias("q")
    joined = p.join(q, F.col("p.game_id").eqNullSafe(F.col("q.game_id")) & (F.col("p.u") == F.col("q.u")))
    return joined.select("p.game_id", "p.u", "p.v", F.least("q.m", "p.u").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u goes to u's least neighbour."""
    both = edges.select("game_id", F.inline(F.array(_pair("u", "v"), _pair("v", "u"))))
    return _least(both).filter("v > u").select("game_id", F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours go to the least of them."""
    down = edges.select("game_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down)
    pairs = near.select("game_id", F.inline(F.array(_pair("v", "m"), _pair("u", "m"))))
    return pairs.filter("u <> v").distinct()


def difference(vectors: list[np.ndarray], bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest differencing. vectors: partitions into at most `bins` sums each. Returns the sums of the combined bins,
    ascending, and for each vector the combined bin of each of its sums."""
    k = len(vectors)
    parent: list[int] = []  # a node is a set of sums that stay together
    heap = []
    nodes0 = []
    for i, v in enumerate(vectors):
        sums = np.zeros(bins)
        node = np.full(bins, -1, np.int64)
        ids = np.arange(len(parent), len(parent) + len(v))
        parent.extend([-1] * len(v))
        nodes0.append(ids)
        sums[: len(v)], node[: len(v)] = v, ids
        order = np.argsort(sums, kind="stable")
        sums, node = sums[order], node[order]
        heap.append((-(sums[-1] - sums[0]), i, sums, node))
    heapq.heapify(heap)
    serial = k
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, nb = a + b[::-1], nb[::-1]  # the largest with the smallest
        node = np.where(na >= 0, na, nb)
        both = np.flatnonzero((na >= 0) & (nb >= 0))
        if len(both):
            made = np.arange(len(parent), len(parent) + len(both))
            parent.extend([-1] * len(both))
            for x, y, p in zip(na[both].tolist(), nb[both].tolist(), made.tolist()):
                parent[x] = parent[y] = p
            node[both] = made
        order = np.argsort(sums, kind="stable")
        sums, node = sums[order], node[order]
        heapq.heappush(heap, (-(sums[-1] - sums[0]), serial, sums, node))
        serial += 1
    _, _, sums, node = heap[0]
    place = np.full(len(parent), -1, np.int64)
    place[node[node >= 0]] = np.flatnonzero(node >= 0)
    for x in range(len(parent) - 1, -1, -1):
        if parent[x] >= 0:
            place[x] = place[parent[x]]
    return sums, [place[ids] for ids in nodes0]


def fill(sums: np.ndarray, ones: int) -> np.ndarray:
    """How many records of weight one each bin gets when they always go to the lowest bin."""
    low, high = int(sums.min()), int(sums.max()) + ones + 1
    while low < high:  # the highest level that they can fill
        level = (low + high + 1) // 2
        if np.maximum(level - sums, 0).sum() <= ones:
            low = level
        else:
            high = level - 1
    extra = np.maximum(low - sums, 0).astype(np.int64)
    rest = ones - int(extra.sum())
    extra[np.flatnonzero(sums + extra <= low)[:rest]] += 1
    return extra


def _pack_group(bins: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "order", "id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        w = pdf["w"].to_numpy()
        heavy = int((w > 1).sum())
        sums, bin_ = np.zeros(bins), np.empty(len(w), np.int64)
        if heavy:
            sums, places = difference([np.array([x], float) for x in w[:heavy]], bins)
            bin_[:heavy] = [p[0] for p in places]
        if heavy < len(w):
            bin_[heavy:] = np.repeat(np.arange(bins), fill(sums, len(w) - heavy))
        return pdf.assign(bin=bin_)[["game_id", "kind", "id", "w", "grp", "bin"]]

    return fn


def _pack_bins(bins: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grp", "bin"]).reset_index(drop=True)
        parts = [p for _, p in pdf.groupby("grp", sort=True)]
        _, places = difference([p["w"].to_numpy(float) for p in parts], bins)
        return pd.concat(parts).assign(to_bin=np.concatenate(places))[["grp", "bin", "up", "to_bin"]]

    return fn


def equal_bins(components: DataFrame, bins: int = BINS, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """Components (game_id, kind, id, w) in bins of their group, as (game_id, kind, id, w, grp, bin); and where each of these
    bins goes among the `bins` nearly equal ones in the end, with its weight, as (grp, bin, w, to_bin)."""
    groups = max(1, -(-components.count() // group_rows))
    order = F.xxhash64("game_id", "kind", "id")
    spread = components.withColumn("order", order).withColumn("grp", F.pmod("order", F.lit(groups)))
    packed = stored(spread.groupBy("grp").applyInPandas(_pack_group(bins), "game_id string, kind string, id bigint, w bigint, grp bigint, bin bigint"))
    # only the bins move from here on: a row for each bin of each group
    moved = cut_lineage(packed.groupBy("grp", "bin").agg(F.sum("w").alias("w")).withColumns({"now": F.col("grp"), "to_bin": F.col("bin")}))
    while groups > 1:
        sums = moved.groupBy("now", "to_bin").agg(F.sum("w").alias("w")).select(F.col("now").alias("grp"), F.col("to_bin").alias("bin"), "w", F.floor(F.col("now") / fan_in).alias("up"))
        moves = sums.groupBy("up").applyInPandas(_pack_bins(bins), "grp bigint, bin bigint, up bigint, to_bin bigint")
        moves = moves.select(F.col("grp").alias("now"), F.col("bin").alias("at"), "up", F.col("to_bin").alias("to"))
        moved = moved.withColumnRenamed("to_bin", "at").join(moves, ["now", "at"])
        moved = cut_lineage(moved.select("grp", "bin", "w", F.col("up").alias("now"), F.col("to").alias("to_bin")))
        groups = -(-groups // fan_in)
    return packed, moved.drop("now")


def allot(sums: list[tuple[int, int]], targets: list[tuple[str, float]]) -> dict[int, str]:
    """Whole bins to splits: largest first, each to the split furthest below its target (ties: the earlier split)."""
    clean = [(s, max(0.0, share) if share is not None and np.isfinite(share) else 0.0) for s, share in targets]
    whole = sum(share for _, share in clean)
    clean = [(s, share / whole if whole else 1 / len(clean)) for s, share in clean]
    total = sum(w for _, w in sums)
    missing = [share * total for _, share in clean]
    out = {}
    for b, w in sorted(sums, key=lambda x: (-x[1], x[0])):
        i = max(range(len(missing)), key=lambda j: (missing[j], -j))
        missing[i] -= w
        out[b] = clean[i][0]
    return out


def assign_splits(tracklets: DataFrame, targets: DataFrame, bins: int = BINS, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """game_id, det_id, split: one row per distinct detection."""
    spark = tracklets.sparkSession
    records = stored(detections(tracklets))
    a, b = records.alias("a"), sized(tie_components(tracklets, records)).alias("b")
    placed = a.join(b, F.col("a.game_id").eqNullSafe(F.col("b.game_id")) & (F.col("a.low") == F.col("b.tracklet")), "left").select(
        "a.game_id", "a.det_id", F.when(F.col("a.low").isNull(), "record").otherwise("tracklet").alias("kind"), F.coalesce("b.root", "a.low", "a.det_id").alias("id")
    )
    packed, moved = equal_bins(placed.groupBy("game_id", "kind", "id").agg(F.count("*").alias("w")), bins, group_rows, fan_in)
    sums = [(r["to_bin"], r["w"]) for r in moved.groupBy("to_bin").agg(F.sum("w").alias("w")).collect()]  # at most `bins` rows
    wanted = [(r["split"], r["share"]) for r in targets.filter("split IS NOT NULL").groupBy("split").agg(F.max("share").alias("share")).orderBy("split").collect()]
    if not wanted:
        raise ValueError("no split is wanted")
    chosen = spark.createDataFrame(list(allot(sums, wanted).items()), "to_bin bigint, split string")
    of_bin = sized(cut_lineage(moved.join(F.broadcast(chosen), "to_bin").select("grp", "bin", "split")))  # at most `bins` rows in chosen
    p, q = placed.alias("p"), packed.join(of_bin, ["grp", "bin"]).alias("q")
    same = F.col("p.game_id").eqNullSafe(F.col("q.game_id")) & (F.col("p.kind") == F.col("q.kind")) & (F.col("p.id") == F.col("q.id"))
    return p.join(q, same).select("p.game_id", "p.det_id", "q.split")


def shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """split, target, n, share, of every wanted split."""
    wanted = targets.filter("split IS NOT NULL").groupBy("split").agg(F.max("share").alias("target"))
    counted = assigned.groupBy("split").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    joined = wanted.join(counted, "split", "left").join(F.broadcast(total))  # one row
    return joined.select("split", "target", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))
