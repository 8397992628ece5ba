"""Problem 5: percentiles per group of very large numeric columns.

Exact percentiles, by distributed multi-select. The counted values are stored once as blocks: the values of one group and
metric that a task has seen, sorted. A range of a group starts as all its values with the ranks wanted in it. In each
round every partition proposes, for each range, the local median of its values in the range, and further fractions (as
many as leave some ``PER_WAY`` values between two, up to ``MOST_WAYS``); the median of the partitions' proposals, weighted by the values behind them, becomes a pivot. All values are counted
three ways against the pivots (below, equal, above: two binary searches in a block), whatever lies in no interval with a
wanted rank is discarded, and a rank that falls on a pivot is found. That repeats per group until at most ``FINISH``
values remain in a range, which are then sorted. Pivots are proposals only: a bad one costs a round and never
correctness.

Scale: the rows are shuffled once, by recording and chunk of frames. A round reads the blocks twice; what it shuffles are
proposals (one per partition, range and fraction; their weighted median is taken in two stages, over ``MEDIAN_OF``
partitions and then over the results, so no task gets more with more partitions) and counts, not values. All levels of
groups share the blocks and the rounds. Ranges are broadcast up to ``MOST_RANGES`` groups, else joined by shuffle, where
adaptive execution splits hot groups.

Combinable results: ``summaries`` makes for each group and part (a game, a day) a list of at most ``POINTS`` values with
weights; ``combine`` merges the summaries of any parts, and both carry the bound of the rank error that they add. So
parts can be made apart and put together later in any order.

Definition: the percentile q of n values is the value of rank max(1, ceil(q n)) in ascending order. Missing values
(NULL, NaN) do not count, infinite ones do; negative and positive zero are equal. A group without values gets NULL and
n = 0; one value is every percentile of its group. Only the newest version of a row counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.grouped import Groups, map_sorted_groups, newest_of_key
from rallyforge.session import cut_lineage
from rallyforge.sources.tables import of_sources

WANTED = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
METRICS = ("speed", "dist_t")
#: Values of a range that are sorted in one go, bound of the rounds; values wanted between two pivots, ways a range is split.
FINISH, MOST_ROUNDS = 256, 60
PER_WAY, LEAST_WAYS, MOST_WAYS = 32, 4, 64
#: Groups whose ranges (some 100 bytes a range, up to 800 with pivots) may be broadcast; partitions behind one median.
MOST_RANGES, MEDIAN_OF = 2_000, 512
#: Proposals and counts that a task holds before it adds them up.
HELD = 1_000_000
#: Points of a summary: each merge adds a rank error of at most 1 / POINTS of its values.
POINTS, FAN_IN = 1_000, 64
CHUNK_FRAMES = 32_768


def counted_values(positions: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """game_id, clip, chunk (of frames), player, day and the metrics of each counted row (missing: NULL)."""
    newest = Window.partitionBy("game_id", "clip", "player", "chunk").orderBy("frame", F.col("ingested_at").desc_nulls_last())
    rows = of_sources(positions).select("game_id", "clip", "player", "frame", "ingested_at", F.floor(F.col("frame") / CHUNK_FRAMES).alias("chunk"), *metrics)
    kept = rows.withColumn("__before", F.lag("frame").over(newest)).filter("__before IS NULL OR __before <> frame")
    return kept.select("game_id", "clip", "chunk", "player", F.to_date("ingested_at").alias("day"), *(F.when(~F.isnan(m), F.col(m)).alias(m) for m in metrics))


def long_values(rows: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """keys..., metric, value of the values that are there."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return rows.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")).filter("value IS NOT NULL").withColumn("value", F.col("value") + F.lit(0.0))


def _same(a: str, b: str, keys: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _range_id(level: Column, keys: list[Column], lo: Column, hi: Column) -> Column:
    """Hash of a range. xxhash64 skips NULLs, so a missing key or open bound is hashed as a flag of its own."""
    return F.xxhash64(level, *keys, *(k.isNull() for k in keys), *(e for c in (lo, hi) for e in (c.isNull(), F.coalesce(c, F.lit(0.0)))))


def value_blocks(positions: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """game_id, player, metric, vals: of the counted rows that a task has together, the sorted values of each group (none:
    an empty list, so that a group without values is known)."""
    rows = of_sources(positions).select("game_id", "clip", "player", "frame", "ingested_at", F.floor(F.col("frame") / CHUNK_FRAMES).alias("chunk"), *metrics)

    def fn(groups: Groups) -> dict:
        g = newest_of_key(groups)
        names = g.table.select(["game_id", "player"])
        code = np.zeros(g.table.num_rows, np.int64)
        for c in names.columns:
            one = c.combine_chunks().dictionary_encode(null_encoding="encode")
            code = code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
        parts, offsets, at, metric = [], [np.zeros(1, np.int64)], [], []
        for m in metrics:
            v = g.column(m).astype(float) + 0.0
            known = ~np.isnan(v)
            order = np.lexsort((v[known], group[known]))
            parts.append(v[known][order])
            offsets.append(offsets[-1][-1] + np.cumsum(np.bincount(group[known], minlength=len(first))))
            at.append(first)
            metric += [m] * len(first)
        values = pa.ListArray.from_arrays(pa.array(np.concatenate(offsets).astype(np.int32)), pa.array(np.concatenate(parts)))
        return g.take(["game_id", "player"], np.concatenate(at)) | {"metric": pa.array(metric), "vals": values}

    order = ["frame", F.col("ingested_at").desc_nulls_last()]
    return map_sorted_groups(rows, ["game_id", "clip", "player", "chunk"], order, fn, "game_id string, player string, metric string, vals array<double>")


def weighted_median(h: np.ndarray, part: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each (h, part) the value at half the weight, and the whole weight."""
    order = np.lexsort((value, part, h))
    h, part, value, weight = h[order], part[order], value[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])) if len(h) else np.zeros(0, np.int64)
    total = np.add.reduceat(weight, first) if len(first) else weight
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    upto = np.cumsum(weight) - np.concatenate([[0], np.cumsum(total)[:-1]])[group] if len(h) else weight
    below = np.bincount(group[2 * upto < total[group]], minlength=len(first))
    return h[first], part[first], value[first + below], total


def _ranges_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each block: its values; of each of its ranges the id, the first and the last place (exclusive) of what lies in it,
    the ways to split it; the pivots of all ranges with their ends."""
    lists, ranges = batch.column("vals"), batch.column("ranges")
    values, cut = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
    flat, ends = ranges.flatten(), np.concatenate([[0], np.cumsum(ranges.value_lengths().to_numpy(zero_copy_only=False))])
    h, lo, hi, ways = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("h", "lo", "hi", "ways"))
    pivots, upto = np.zeros(0), np.zeros(len(h) + 1, np.int64)
    if "pivots" in [f.name for f in flat.type]:
        p = flat.field("pivots")
        pivots, upto = p.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(p.value_lengths().to_numpy(zero_copy_only=False))])
    for i in range(batch.num_rows):
        v, r = values[cut[i] : cut[i + 1]], slice(ends[i], ends[i + 1])
        a = np.where(np.isnan(lo[r]), 0, np.searchsorted(v, lo[r], "right"))
        b = np.where(np.isnan(hi[r]), len(v), np.searchsorted(v, hi[r], "left"))
        yield v, h[r], a, np.maximum(a, b), ways[r], pivots, upto[ends[i] : ends[i + 1] + 1]


def _gathered(batches: Iterator[pa.RecordBatch], per_block, added, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What per_block makes of each block, added up by `added` for the whole partition."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for block in _ranges_of(batch):
            made = per_block(*block)
            held.append(made)
            size += len(made[0])
            if size > HELD:
                held = [added(*(np.concatenate(c) for c in zip(*held)))]
                size = len(held[0][0])
                if size > HELD // 2:  # hardly anything in common
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held.pop()], names=names)
                    size = 0
    if held:
        out = pa.table(dict(zip(names, added(*(np.concatenate(c) for c in zip(*held))))))
        yield from out.to_batches(max_chunksize=65_536)


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def per_block(v, h, a, b, ways, *_):
        made = [(np.full(w - 1, i), np.arange(1, w), v[x + (np.arange(1, w) * (y - x) - 1).clip(0) // w], np.full(w - 1, y - x)) for i, x, y, w in zip(h, a, b, ways) if x < y]
        return tuple(np.concatenate(c) for c in zip(*made)) if made else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))

    yield from _gathered(batches, per_block, weighted_median, ["h", "part", "value", "weight"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code 2 i: between pivots i - 1 and i; 2 i + 1: equal to pivot i."""

    def per_block(v, h, a, b, _, pivots, upto):
        ids, codes, counts = [], [], []
        for k in np.flatnonzero(a < b).tolist():
            p = pivots[upto[k] : upto[k + 1]]
            inner = v[a[k] : b[k]]
            edges = np.stack([np.searchsorted(inner, p, "left"), np.searchsorted(inner, p, "right")], axis=1).ravel()
            n = np.diff(np.concatenate([[0], edges, [len(inner)]]))
            some = np.flatnonzero(n)
            ids.append(np.full(len(some), h[k]))
            codes.append(some)
            counts.append(n[some])
        return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ids, codes, counts))

    def added(h, code, n):
        order = np.lexsort((code, h))
        h, code, n = h[order], code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (code[1:] != code[:-1])])) if len(h) else np.zeros(0, np.int64)
        return h[first], code[first], np.add.reduceat(n, first) if len(first) else n

    yield from _gathered(batches, per_block, added, ["h", "code", "n"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The values of each range and block."""
    for batch in batches:
        ids, parts = [], []
        for v, h, a, b, *_ in _ranges_of(batch):
            for k in np.flatnonzero(a < b).tolist():
                ids.append(h[k])
                parts.append(v[a[k] : b[k]])
        if ids:
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))], names=["h", "vals"])


def _medians(groups: Groups) -> dict:
    """Rows of (h, salt) sorted by part: the weighted median of each part."""
    h, part, value, weight = weighted_median(groups.of_row(), groups.column("part"), groups.column("value"), groups.column("weight"))
    return groups.take(["h"], groups.start[:-1][h]) | {"part": part, "value": value, "weight": weight}


def _pivots(groups: Groups) -> dict:
    """Rows of h sorted by part: the different weighted medians, ascending."""
    h, _, value, _ = weighted_median(groups.of_row(), groups.column("part"), groups.column("value"), groups.column("weight"))
    order = np.lexsort((value, h))
    h, value = h[order], value[order]
    keep = np.concatenate([[True], (h[1:] != h[:-1]) | (value[1:] != value[:-1])])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(h[keep], minlength=len(groups)))]).astype(np.int32)
    return groups.take(["h"], groups.start[:-1]) | {"pivots": pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[keep]))}


def ways_of(n: Column) -> Column:
    return F.least(F.lit(MOST_WAYS), F.greatest(F.lit(LEAST_WAYS), F.ceil(n / PER_WAY))).cast("int")


class Selection:
    """Multi-select over blocks for several levels of groups at once. levels: the key columns of each."""

    def __init__(self, blocks: DataFrame, levels: list[list[str]], finish: int = FINISH):
        self.blocks, self.levels, self.finish = blocks, levels, finish
        self.keys = [*dict.fromkeys(k for level in levels for k in level), "metric"]
        self.salts = -(-max(1, blocks.rdd.getNumPartitions()) // MEDIAN_OF)

    def of_level(self, df: DataFrame, level: int) -> DataFrame:
        """df with the keys that are not the level's as NULL."""
        own = [*self.levels[level], "metric"]
        return df.withColumns({k: F.lit(None).cast(self.blocks.schema[k].dataType) for k in self.keys if k not in own}).withColumn("level", F.lit(level))

    def sizes(self) -> DataFrame:
        """level, keys..., n."""
        each = [self.of_level(self.blocks.groupBy(*level, "metric").agg(F.sum(F.size("vals")).cast("bigint").alias("n")), i) for i, level in enumerate(self.levels)]
        return cut_lineage(reduce(DataFrame.unionByName, [e.select("level", *self.keys, "n") for e in each]))

    def with_ids(self, ranges: DataFrame) -> DataFrame:
        return ranges.withColumn("h", _range_id(F.col("level"), [F.col(k) for k in self.keys], F.col("lo"), F.col("hi")))

    def of_levels(self, ranges: DataFrame) -> dict[int, int]:
        """Ranges of each level that has some: as many rows as there are levels."""
        return {r["level"]: r["count"] for r in ranges.groupBy("level").count().collect()}

    def joined(self, ranges: DataFrame, counts: dict[int, int], *columns: str) -> DataFrame:
        """vals, ranges: the blocks with the ranges of their groups; each group's few ranges come as one list."""
        rows, lists = self.blocks, []
        for i, level in enumerate(self.levels):
            if i not in counts:
                continue
            own = [*level, "metric"]
            per = ranges.filter(F.col("level") == i).groupBy(*own).agg(F.collect_list(F.struct("h", "lo", "hi", ways_of(F.col("n")).alias("ways"), *columns)).alias(f"r{i}"))
            a, b = rows.alias("a"), (F.broadcast(per) if counts[i] <= MOST_RANGES else per).alias("b")
            rows = a.join(b, _same("a", "b", own), "left").select("a.*", f"b.r{i}")
            lists.append(F.coalesce(F.col(f"r{i}"), F.array().cast(per.schema[f"r{i}"].dataType)))
        return rows.select("vals", F.concat(*lists).alias("ranges")).filter("size(vals) > 0 AND size(ranges) > 0")

    def whole(self, sizes: dict[int, float]) -> DataFrame:
        """Blocks with the range of all values of each of their groups: known without a join. sizes: mean values of a group of
        each level, which the ways go by."""
        none, cols = F.lit(None).cast("double"), []
        for i, level in enumerate(self.levels):
            keys = [F.col(k) if k in (*level, "metric") else F.lit(None).cast(self.blocks.schema[k].dataType) for k in self.keys]
            cols.append(F.struct(_range_id(F.lit(i), keys, none, none).alias("h"), none.alias("lo"), none.alias("hi"), ways_of(F.lit(float(sizes.get(i, 1)))).alias("ways")))
        return self.blocks.select("vals", F.array(*cols).alias("ranges")).filter("size(vals) > 0")

    def pivots(self, found: DataFrame) -> DataFrame:
        """h, pivots (ascending) of the proposals."""
        proposals = found.mapInArrow(_propose, "h bigint, part bigint, value double, weight bigint")
        ddl = "h bigint, part bigint, value double, weight bigint"
        if self.salts > 1:
            proposals = map_sorted_groups(proposals.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(self.salts))), ["h", "salt"], ["part"], _medians, ddl)
        return map_sorted_groups(proposals, ["h"], ["part"], _pivots, "h bigint, pivots array<double>")

    def narrowed(self, pivoted: DataFrame, counts: dict[int, int]) -> DataFrame:
        """What remains of the ranges: level, keys, value (found) or lo, hi; n, targets."""
        # partitions have added up their counts; so they go straight to where a range's counts are put together
        found = self.joined(pivoted, counts, "pivots").mapInArrow(_count, "h bigint, code bigint, n bigint").repartition("h").groupBy("h", "code").agg(F.sum("n").alias("n"))
        per = found.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("counts"))  # at most 2 * MOST_WAYS - 1
        each = pivoted.drop("n").join(per, "h").withColumn("target", F.explode("targets")).drop("targets")
        start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(-1).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("n"))
        step = lambda s, c: F.when(s["below"] + s["n"] > F.col("target.k"), s).otherwise(
            F.struct((s["below"] + s["n"]).alias("below"), c["code"].alias("code"), c["n"].alias("n"))
        )
        at = each.withColumn("at", F.aggregate("counts", start, step)).select(
            "h", "level", *self.keys, "lo", "hi", "pivots", "at", F.struct(F.col("target.q").alias("q"), (F.col("target.k") - F.col("at.below")).alias("k")).alias("target")
        )
        left = at.groupBy("h", F.col("at.code").alias("code")).agg(*(F.first(c).alias(c) for c in ("level", *self.keys, "lo", "hi", "pivots")), F.first("at.n").alias("n"), F.collect_list("target").alias("targets"))
        i, on = F.floor(F.col("code") / 2).cast("int"), F.col("code") % 2 == 1
        pivot = lambda k: F.get("pivots", k)
        return cut_lineage(
            left.select(
                "level", *self.keys, F.when(on, pivot(i)).alias("value"), F.when(~on, F.when(i > 0, pivot(i - 1)).otherwise(F.col("lo"))).alias("lo"),
                F.when(~on, F.when(i < F.size("pivots"), pivot(i)).otherwise(F.col("hi"))).alias("hi"), "n", "targets",
            )
        )

    def run(self, wanted: tuple[float, ...]) -> DataFrame:
        """level (place in levels), keys..., q, n, value, for every group and metric."""
        none = F.lit(None).cast("double")
        sizes = self.sizes()
        target = F.array(*(F.struct(F.lit(float(q)).alias("q"), (F.greatest(F.lit(1), F.ceil(F.lit(float(q)) * F.col("n"))) - 1).cast("bigint").alias("k")) for q in wanted))
        ranges = sizes.filter("n > 0").select("level", *self.keys, none.alias("lo"), none.alias("hi"), "n", target.alias("targets"))
        small, found = [ranges.filter(F.col("n") <= self.finish)], []
        open_ = self.with_ids(ranges.filter(F.col("n") > self.finish))
        mean = {r["level"]: r["n"] for r in ranges.groupBy("level").agg(F.avg("n").alias("n")).collect()}
        for turn in range(MOST_ROUNDS):
            counts = self.of_levels(open_)
            if not counts:
                break
            pivots = self.pivots(self.joined(open_, counts) if turn else self.whole(mean))
            after = self.narrowed(cut_lineage(open_.join(pivots, "h")), counts)
            found.append(after.filter("value IS NOT NULL").select("level", *self.keys, "value", F.explode("targets.q").alias("q")))
            rest = after.filter("value IS NULL").drop("value")
            small.append(rest.filter(F.col("n") <= self.finish))
            open_ = self.with_ids(rest.filter(F.col("n") > self.finish))
        else:
            raise RuntimeError("multi-select did not end")
        last = self.with_ids(reduce(DataFrame.unionByName, [s.select("level", *self.keys, "lo", "hi", "n", "targets") for s in small]))
        counts = self.of_levels(last)
        if counts:
            each = self.joined(last, counts).mapInArrow(_values, "h bigint, vals array<double>")
            sorted_ = each.groupBy("h").agg(F.sort_array(F.flatten(F.collect_list("vals"))).alias("all"))  # at most finish values
            picked = last.join(sorted_, "h").select("level", *self.keys, "all", F.explode("targets").alias("target"))
            found.append(picked.select("level", *self.keys, F.element_at("all", (F.col("target.k") + 1).cast("int")).alias("value"), F.col("target.q").alias("q")))
        empty = sizes.filter("n = 0").select("level", *self.keys, none.alias("value"), F.explode(F.array(*(F.lit(float(q)) for q in wanted))).alias("q"))
        a, b = reduce(DataFrame.unionByName, [empty, *found]).alias("a"), sizes.alias("b")
        return a.join(b, _same("a", "b", ["level", *self.keys])).select("b.*", "a.q", "a.value").select("level", *self.keys, "q", "n", "value")


def percentiles(positions: DataFrame, finish: int = FINISH, wanted: tuple[float, ...] = WANTED) -> DataFrame:
    """Per player, and per game and player: level, game_id, player, metric, q, n, value, rank_error (0: exact)."""
    blocks = cut_lineage(value_blocks(positions))
    made = Selection(blocks, [["player"], ["game_id", "player"]], finish).run(wanted)
    level = F.when(F.col("level") == 0, "player").otherwise("game_player").alias("level")
    return made.select(level, "game_id", "player", "metric", "q", "n", "value", F.lit(0).cast("bigint").alias("rank_error"))


# ---- combinable summaries


def condense(v: np.ndarray, w: np.ndarray, start: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with weights, ascending within each group, to at most about 2 * points for each group: the kept rows, their new
    weights and the rank error that this adds to each group. Values up to the next of `points` equally spaced ranks are
    represented by the last of them, so a rank is off by less than the weight merged there; a value that weighs as much as
    such a step keeps its place, and groups of at most `points` values are kept as they are."""
    size = np.diff(start)
    gid = np.repeat(np.arange(len(size)), size)
    total = np.cumsum(w)
    before = np.concatenate([[0], total])[start[:-1]]
    weight = np.concatenate([[0], total])[start[1:]] - before
    step = np.where(size > points, -(-weight // points), 1)[gid]
    cell = (total - before[gid] - 1) // step
    heavy = w >= step
    edge = np.ones(len(v), bool)
    edge[:-1] = (gid[1:] != gid[:-1]) | (cell[1:] != cell[:-1]) | heavy[:-1] | heavy[1:]
    kept = np.flatnonzero(edge)
    merged = np.diff(np.concatenate([[0], total[kept]]))
    error = np.zeros(len(size), np.int64)
    np.maximum.at(error, gid[kept], merged - w[kept])
    return kept, merged, error


SUMMARY = "points array<struct<v: double, w: bigint>>, n bigint, rank_error bigint"


def _condensed(rows: DataFrame, keys: list[str], also: list[str]) -> DataFrame:
    """Summaries of rows (keys, also, v, w, n, rank_error) by keys and also; n and rank_error add up. A group must have a
    bound, which the columns in also are there for."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)
    points = POINTS

    def fn(g: Groups) -> dict:
        v, w = g.column("v"), g.column("w")
        kept, merged, error = condense(v, w, g.start, points)
        offsets = np.searchsorted(kept, g.start).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(v[kept]), pa.array(merged)], names=["v", "w"])
        first = g.start[:-1]
        return g.take(keys, first) | {
            "points": pa.ListArray.from_arrays(pa.array(offsets), pairs), "n": np.add.reduceat(g.column("n"), first),
            "rank_error": np.add.reduceat(g.column("rank_error"), first) + error,
        }

    return map_sorted_groups(rows, [*keys, *also], ["v"], fn, f"{ddl}, {SUMMARY}")


def combine(parts: DataFrame, groups: list[str]) -> DataFrame:
    """Merge summaries (points, n, rank_error) of the same group: in steps of at most FAN_IN or so, so no task ever gets all
    parts of a hot group."""
    keys = [*groups, "metric"]
    parts = cut_lineage(parts.select(*keys, "points", "n", "rank_error"))
    while True:
        most = parts.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
        salts = 1 if most <= FAN_IN else -(-most // (FAN_IN // 2))
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("points", "n", F.monotonically_increasing_id()), F.lit(salts)))
        first = F.col("i") == 0
        points = salted.select(*keys, "salt", "n", "rank_error", F.posexplode("points").alias("i", "p")).select(
            *keys, "salt", "p.v", "p.w", F.when(first, F.col("n")).otherwise(F.lit(0)).alias("n"), F.when(first, F.col("rank_error")).otherwise(F.lit(0)).alias("rank_error")
        )
        merged = _condensed(points, keys, ["salt"])
        if salts == 1:
            return merged
        parts = cut_lineage(merged)


def summaries(positions: DataFrame, groups: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Summaries of each group (of game_id, player, day) and metric, a row for each recording and chunk of frames in it, to
    be combined at will: groups..., metric, points, n, rank_error."""
    rows = long_values(counted_values(positions, metrics), [*groups, "clip", "chunk"], metrics)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    also = [c for c in ("clip", "chunk") if c not in groups]
    return _condensed(rows.withColumnRenamed("value", "v").withColumns({"w": one, "n": one, "rank_error": none}), [*groups, "metric"], also)


def of_summary(parts: DataFrame, groups: list[str], wanted: tuple[float, ...] = WANTED) -> DataFrame:
    """Percentiles of summaries: groups..., metric, q, n, value, rank_error (the value's rank is off by at most so many)."""
    keys = [*groups, "metric"]
    points = parts.select(*keys, "n", "rank_error", F.posexplode("points").alias("i", "p"))
    w = Window.partitionBy(*keys).orderBy("i")
    below = points.select(*keys, "n", "rank_error", "p.v", F.sum("p.w").over(w).alias("upto"))
    targets = below.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in wanted))))
    return (
        targets.filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n"))))
        .groupBy(*keys, "q").agg(F.first("n").alias("n"), F.min("v").alias("value"), F.first("rank_error").alias("rank_error"))
    )
