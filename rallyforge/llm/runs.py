"""Problem 1: collapse runs of repeated consecutive events of an ordered sequence.

Method: adjacent agglomeration. Each row starts as a run of its own; the runs of an entity form a linked list, and a
priority queue holds the links between neighbouring runs by dissimilarity (that of their facing rows). The most
similar neighbours merge first, until no link meets the similarity and gap limits.

Scale: an entity may be of any length, so it is cut into chunks of ``CHUNK_FRAMES`` frames (frames are unique after
the newest version of each key is chosen, which bounds a chunk). Runs that touch a chunk's end are few; a window over
them alone joins those that go on in the next chunk. One shuffle of the needed columns, one of the boundary runs; the runs
are stored in between, so that Python runs once and complete runs are not shuffled at all.

Defined results: rows without player or frame belong to no entity; of rows with equal key the newest counts; a
missing or infinite speed or dist_t meets no limit, so such a row is a run of its own; a game without a stride takes
the stride 1; a missing t gives a duration from the remaining rows, NULL if none is left; empty input gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.grouped import Groups, map_sorted_groups, newest_of_key
from rallyforge.session import lookup, stored
from rallyforge.sources.tables import game_strides, of_sources

CHUNK_FRAMES = 32_768
SOURCE = ["game_id", "clip", "player"]
#: Limits of problem 1, in ten-thousandths and in strides.
SPEED_LIMIT, DIST_LIMIT, GAP_STRIDES = 200, 200, 3
UNIT = 10_000
#: Up to here a number of ten-thousandths is a whole double.
EXACT = 9e11

RUN_SCHEMA = (
    "game_id string, clip int, player string, chunk bigint, stride int, frame_first bigint, frame_last bigint, n_rows bigint, "
    "t_first double, t_last double, v_first double, d_first double, v_last double, d_last double, "
    "at_start boolean, at_end boolean"
)


def agglomerate(cost: np.ndarray, n: int) -> np.ndarray:
    """Merge neighbours of a list of n rows. cost[i] is the dissimilarity of rows i and i+1, -1 where a limit forbids
    the merge. Returns the first row of each resulting run.

    The list is kept by run ends: last[h] of a run's first row h, first[t] of its last row t."""
    first, last = list(range(n)), list(range(n))
    queue = [(c, i) for i, c in enumerate(cost.tolist()) if c >= 0]
    heapq.heapify(queue)
    pop = heapq.heappop
    while queue:
        _, i = pop(queue)  # the link stays between the same facing rows, however long both runs have grown
        head, tail = first[i], last[i + 1]
        last[head], first[tail] = tail, head
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = last[i] + 1
    return np.array(starts, np.int64)


def apart(a, b, f=np):
    """Distance in whole ten-thousandths; NaN if either is not finite. Numbers so large that their ten-thousandths are no whole
    doubles any more are subtracted first. f: numpy, or functions of Columns."""
    if f is np:
        with np.errstate(invalid="ignore", over="ignore"):
            return np.where(np.maximum(np.abs(a), np.abs(b)) < EXACT, np.abs(np.rint(a * UNIT) - np.rint(b * UNIT)), np.rint(np.abs(a - b) * UNIT))
    return F.when(F.greatest(F.abs(a), F.abs(b)) < EXACT, F.abs(F.rint(a * UNIT) - F.rint(b * UNIT))).otherwise(F.rint(F.abs(a - b) * UNIT))


def _runs(speed_limit: int, dist_limit: int, gap_strides: int):
    def fn(groups: Groups) -> dict:
        g = newest_of_key(groups)
        v, d = (np.where(np.isfinite(c), c, np.nan) for c in (g.column("speed").astype(float), g.column("dist_t").astype(float)))
        frame, t, stride = g.column("frame"), g.column("t").astype(float), g.column("stride")
        a, b = apart(v[1:], v[:-1]), apart(d[1:], d[:-1])
        fits = (a <= speed_limit) & (b <= dist_limit) & (np.diff(frame) <= gap_strides * stride[1:])
        cost = np.where(fits, a + b, -1.0)
        starts = [s + agglomerate(cost[s : e - 1], e - s) for s, e in zip(g.start[:-1], g.start[1:]) if e > s]
        lo = np.concatenate(starts)
        hi = np.append(lo[1:], len(frame)) - 1
        begins, ends = np.zeros(len(frame), bool), np.zeros(len(frame), bool)
        some = np.diff(g.start) > 0
        begins[g.start[:-1][some]] = True
        ends[g.start[1:][some] - 1] = True
        known = np.where(np.isfinite(t), t, np.nan)
        down, up = np.fmin.reduceat(known, lo), np.fmax.reduceat(known, lo)
        inner = ~(begins[lo] | ends[hi])  # complete: nothing of its ends is needed any more
        at_end = lambda v: pa.array(v, mask=inner)
        return g.take(["game_id", "clip", "player", "chunk", "stride"], lo) | {
            "frame_first": frame[lo], "frame_last": frame[hi], "n_rows": hi - lo + 1, "t_first": down, "t_last": up,
            "v_first": at_end(v[lo]), "d_first": at_end(d[lo]), "v_last": at_end(v[hi]), "d_last": at_end(d[hi]), "at_start": begins[lo], "at_end": ends[hi],
        }

    return fn


def collapse_runs(
    positions: DataFrame, games: DataFrame, speed_limit: int = SPEED_LIMIT, dist_limit: int = DIST_LIMIT,
    gap_strides: int = GAP_STRIDES, least_rows: int = 1, chunk_frames: int = CHUNK_FRAMES,
) -> DataFrame:
    """One row per run of at least least_rows rows: source, frame_first, frame_last, n_rows, duration (in t, NULL when no t is known)."""
    rows = lookup(of_sources(positions).select(*SOURCE, "frame", "t", "speed", "dist_t", "ingested_at"), game_strides(games), ["game_id"])
    rows = rows.withColumn("stride", F.coalesce("stride", F.lit(1))).withColumn("chunk", F.floor(F.col("frame") / chunk_frames))
    runs = map_sorted_groups(
        rows, [*SOURCE, "chunk"], ["frame", F.col("ingested_at").desc_nulls_last()], _runs(speed_limit, dist_limit, gap_strides), RUN_SCHEMA
    )
    edge = F.col("at_start") | F.col("at_end")
    runs = stored(runs.filter(edge | (F.col("n_rows") >= least_rows)))
    known = lambda c: F.when(~F.isnan(c), F.col(c))
    w = Window.partitionBy(*SOURCE).orderBy("frame_first")
    near = lambda c, limit: apart(F.col(f"{c}_first"), F.lag(f"{c}_last").over(w), F) <= limit
    both = ~F.isnan("v_first") & ~F.isnan("d_first") & ~F.isnan(F.lag("v_last").over(w)) & ~F.isnan(F.lag("d_last").over(w))
    follows = F.col("at_start") & F.lag("at_end").over(w) & (F.col("frame_first") - F.lag("frame_last").over(w) <= gap_strides * F.col("stride"))
    goes_on = follows & both & near("v", speed_limit) & near("d", dist_limit)
    joined = (
        runs.filter(edge).withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(w)).groupBy(*SOURCE, "run")
        .agg(
            F.min("frame_first").alias("frame_first"), F.max("frame_last").alias("frame_last"), F.sum("n_rows").alias("n_rows"),
            F.min(known("t_first")).alias("t_first"), F.max(known("t_last")).alias("t_last"),
        )
        .filter(F.col("n_rows") >= least_rows).drop("run")
    )
    both_kinds = runs.filter(~edge).select(*joined.columns).unionByName(joined)
    return both_kinds.select(*SOURCE, "frame_first", "frame_last", "n_rows", F.round(known("t_last") - known("t_first"), 6).alias("duration"))
