"""Problem 2: implausible readings, flagged per source against that source's own behaviour.

Method: robust principal components of profile matrices. A profile is a period of a source, ``PROFILE`` successive
sampling intervals on a fixed grid of frames; the profiles of a source and metric are the rows of a matrix. It is split
into a low-rank part (what the source does: level, drift, turns) and a sparse part (what it does not):

1. Every profile is fitted on smooth curves with weights that fall with the residual, and clipped to ``CLIP`` residual scales around that fit, so that spikes hardly count in what follows.
2. The Gram matrix of the clipped profiles, with a prior worth ``PRIOR`` smooth profiles, gives the ``RANK`` leading
   components of the source.
3. Every profile is fitted on its source's components in the same robust way: that is the low-rank part, the residuals are
   the sparse part. Two grids half a profile apart are used, and each row takes the residual of the profile in which it
   lies more centrally.
4. A reading is a spike when its sparse part exceeds ``FAR`` times the residual scale of its source. For places that scale
   is 1.4826 x the median absolute residual; for speed, where only what lies far above all else counts, it is the 95th
   percentile. An exact check follows. x and y: at most ``BRIEF_ROWS`` in a row, with true readings directly before and
   after that lie less than half as far off. Speed: the sparse part alone exceeds every other speed of the source.

Places enter as a path without jumps: the step over missing rows and over stuck series is taken out, for the first true row
after them may lie anywhere. Constant runs and ranges are tested separately.

Scale: one shuffle of the needed columns, by source and chunk of ``CHUNK_PROFILES`` profiles, so a source of any length is
spread over tasks. What a source is judged by are sums: Gram matrices, and counts (with the largest speed) of residuals in classes of
1 %. A source within one chunk, the rule, is finished in that pass. The others are found among the chunks seen; for them the sums of
their chunks are added up over the whole source and two more passes over their rows, with the common components and then
with the common scale, flag them. Both ways compute the same. Stuck series go on over chunk ends by their lengths there.

Defined results: rows without player or frame belong to no source; of rows with an equal key the newest counts.
NULL and NaN are missing and no fault. A series is broken by a missing value, not by a missing frame. A game without
stride takes 1. Empty input gives no rows. Columns that are not used are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.functions.court import LENGTH, WIDTH
from rallyforge.operators.grouped import Groups, map_sorted_groups, newest_of_key
from rallyforge.session import cut_lineage, lookup
from rallyforge.sources.tables import game_strides, of_sources

SOURCE = ["game_id", "clip", "player"]
PROFILE, RANK, CLIP = 16, 3, 4.0
#: A fit's rounds; a cell weighs 1 / residual ** SHARPNESS (1 would be least absolute deviations).
ROUNDS, SHARPNESS = 6, 1.5
#: Prior of the components in profiles; ridge on the components of a fit, which matters for profiles with few rows only.
PRIOR, RIDGE = 20.0, 0.3
#: Residuals up to this (metres, metres a second) are noise of a reading and weigh alike.
NOISE = 0.02
CHUNK_PROFILES, HALO = 2_048, 2
#: Constant series: at least so many successive equal readings. Excursions: at most so many.
STUCK_ROWS, BRIEF_ROWS = 8, 3
RANGES = {"x": (0.0, WIDTH), "y": (0.0, LENGTH), "speed": (0.0, np.finfo(float).max)}
#: Quantile and factor that make the residual scale, and the multiple of it beyond which a reading is a spike.
SCALES = {"x": (0.5, 1.4826), "y": (0.5, 1.4826), "speed": (0.95, 1.0)}
FAR = {"x": 33.0, "y": 33.0, "speed": 4.5}
LEAST_SCALE = 0.005
KINDS = ["range", "stuck", "spike"]
#: Classes of residuals: class c holds those up to LEAST_SCALE * WIDTH_OF_CLASS ** c.
WIDTH_OF_CLASS, CLASSES = 1.01, 2_048
FLAGS = "game_id string, clip int, player string, frame bigint, x_fault string, y_fault string, speed_fault string"


def grouped_quantile(v: np.ndarray, gid: np.ndarray, n_groups: int, q: float) -> np.ndarray:
    """Lower empirical quantile of each group; NaN for empty groups."""
    order = np.lexsort((v, gid))
    count = np.bincount(gid, minlength=n_groups)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    out = np.full(n_groups, np.nan)
    some = count > 0
    out[some] = v[order][(start + np.floor(q * np.maximum(count - 1, 0)).astype(np.int64))[some]]
    return out


def stuck(v: np.ndarray, present: np.ndarray, start: np.ndarray, least: int = STUCK_ROWS, into: tuple | None = None, out_of: tuple | None = None) -> np.ndarray:
    """Rows in a series of at least so many successive rows of the group with exactly one value. into, out_of: value and
    length, for each group, of the series that ends right before it and of the one that begins right after it."""
    breaks = np.ones(len(v), bool)
    breaks[1:] = (v[1:] != v[:-1]) | ~present[1:] | ~present[:-1]
    some = np.diff(start) > 0
    first, last = start[:-1][some], start[1:][some] - 1
    breaks[first] = True
    run = np.cumsum(breaks) - 1
    size = np.bincount(run) if len(v) else np.zeros(0, np.int64)
    for rows, series in ((first, into), (last, out_of)):
        if series is not None:
            value, length = series[0][some], series[1][some]
            np.add.at(size, run[rows], np.where(present[rows] & (v[rows] == value), length, 0))
    return present & (size[run] >= least)


def robust_fit(matrix: np.ndarray, has: np.ndarray, basis: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Fit of each row on the columns of basis (the first is the level), by iterated weights; the last weights."""
    k = basis.shape[1]
    products = (basis[:, :, None] * basis[:, None, :]).reshape(len(basis), -1)
    ridge = RIDGE * np.diag([1e-6] + [1.0] * (k - 1))
    w = has.astype(float) if weights is None else weights
    for _ in range(ROUNDS):
        a = (w @ products).reshape(-1, k, k) + ridge
        fit = np.linalg.solve(a, ((w * matrix) @ basis)[..., None])[..., 0] @ basis.T
        w = has / np.maximum(np.abs(matrix - fit), NOISE)**SHARPNESS
    return fit, w


def smooth_basis() -> np.ndarray:
    """Level and the first RANK smooth curves of a profile, orthonormal."""
    return np.linalg.qr(np.vander(np.linspace(-1, 1, PROFILE), RANK + 1, increasing=True))[0]


class Profiles:
    """The profiles of one grid: usable rows of all groups, cut by interval number."""

    def __init__(self, value: np.ndarray, gid: np.ndarray, interval: np.ndarray, offset: int, n_groups: int):
        cell = (interval + offset) // PROFILE
        new = np.ones(len(value), bool)
        new[1:] = (gid[1:] != gid[:-1]) | (cell[1:] != cell[:-1])
        within = np.arange(len(value)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        new |= within % PROFILE == 0  # frames denser than the stride: a profile goes on in another
        self.row, self.slot = np.cumsum(new) - 1, within % PROFILE
        first = np.flatnonzero(new)
        self.gid, self.begin = gid[first], cell[first] * PROFILE - offset
        self.bounds = np.searchsorted(self.gid, np.arange(n_groups + 1))
        matrix = np.full((len(first), PROFILE), np.nan)
        matrix[self.row, self.slot] = value
        self.has = ~np.isnan(matrix)
        size = self.has.sum(axis=1)
        self.central = np.abs(self.slot - (size[self.row] - 1) / 2)
        ordered = np.sort(matrix, axis=1)  # NaN last
        middle = (ordered[np.arange(len(size)), (size - 1) // 2] + ordered[np.arange(len(size)), size // 2]) / 2
        self.matrix = np.where(self.has, matrix - middle[:, None], 0.0)
        fit, self.weights = robust_fit(self.matrix, self.has, smooth_basis()) if len(first) else (self.matrix, None)
        off = np.abs(self.matrix - fit)
        scale = np.sort(np.where(self.has, off, np.inf), axis=1)[np.arange(len(size)), (size - 1) // 2]
        limit = CLIP * np.maximum(1.4826 * scale, NOISE)[:, None]
        clipped = np.where(self.has, fit + np.clip(self.matrix - fit, -limit, limit), fit)
        self.clipped = clipped - clipped.mean(axis=1, keepdims=True)

    def gram(self, own: np.ndarray) -> np.ndarray:
        """Sums, for each group, over its own profiles."""
        rows = np.where(own[:, None], self.clipped, 0.0)
        return np.stack([rows[a:b].T @ rows[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:])])

    def sparse(self, components: np.ndarray) -> np.ndarray:
        """Residual of each row; components: RANK columns for each group."""
        level = np.full((PROFILE, 1), PROFILE**-0.5)
        rest = np.zeros_like(self.matrix)
        for g, (a, b) in enumerate(zip(self.bounds[:-1], self.bounds[1:])):
            if a < b:
                fit, _ = robust_fit(self.matrix[a:b], self.has[a:b], np.hstack([level, components[g]]), self.weights[a:b])
                rest[a:b] = self.matrix[a:b] - fit
        return rest[self.row, self.slot]


def components(gram: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Leading components of each source from its Gram matrix of so many profiles, drawn to smooth curves by the prior."""
    smooth = smooth_basis()[:, 1:]
    share = gram / np.maximum(np.trace(gram, axis1=1, axis2=2), 1e-12)[:, None, None]
    return np.linalg.eigh(share * count[:, None, None] + PRIOR / RANK * (smooth @ smooth.T))[1][:, :, -RANK:]


def classes_of(rest: np.ndarray) -> np.ndarray:
    size = np.maximum(np.abs(rest) / LEAST_SCALE, 1.0)
    return np.minimum(np.ceil(np.log(size) / np.log(WIDTH_OF_CLASS) - 1e-9), CLASSES - 1).astype(np.int64)


def brief(off: np.ndarray, hit: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Hits of one sign that make up at most BRIEF_ROWS rows, with successive true readings before and after, to which the
    path comes back: those lie less than half as far off as each of the hits."""
    out = np.zeros(len(off), bool)
    sign = np.where(hit, np.sign(off), 0)
    same = np.zeros(len(off), bool)
    same[1:] = near[1:] & (sign[1:] == sign[:-1]) & hit[1:]
    first = np.flatnonzero(hit & ~same)
    size = np.bincount(np.cumsum(hit & ~same)[hit], minlength=len(first) + 1)[1:]
    fine = (size <= BRIEF_ROWS) & (first > 0) & (first + size < len(off))
    first, size = first[fine], size[fine]
    before, after = first - 1, first + size
    ends = np.maximum(np.abs(off[before]), np.abs(off[after]))
    fine = near[first] & near[after]
    for k in range(BRIEF_ROWS):
        fine &= (k >= size) | (2 * ends < np.abs(off[np.minimum(first + k, len(off) - 1)]))
    for k in range(BRIEF_ROWS):
        out[(first + k)[fine & (k < size)]] = True
    return out


def chunk_of(profile, chunk_profiles: int):
    """Chunks do not end at profile 0, where clips start, so few rows are needed by two chunks."""
    return (profile + chunk_profiles // 2) // chunk_profiles


class Chunk:
    """The counted rows of groups (source and chunk). info: for each group, what is known of its source and of its
    neighbours (see INFO), or None where a group is the whole source."""

    def __init__(self, groups: Groups, chunk_profiles: int):
        self.info = None
        if "info" in groups.table.column_names:
            groups = self._take_info(groups)
        self.g = g = newest_of_key(groups)
        self.start, self.n, self.gid = g.start, int(g.start[-1]), g.of_row()
        self.groups, self.chunk_profiles = len(g), chunk_profiles
        self.stride, self.frame, self.own = g.column("stride").astype(np.int64), g.column("frame").astype(np.int64), g.column("own").astype(bool)
        self.interval = self.frame // self.stride
        self.chunk = g.column("chunk").astype(np.int64)

    def _take_info(self, groups: Groups) -> Groups:
        """The rows that carry it are set apart; groups without one hold rows of neighbours only and are left out."""
        there = np.asarray(groups.table.column("info").is_valid())
        at = np.flatnonzero(there)
        known = np.zeros(len(groups), bool)
        known[groups.of_row()[at]] = True
        values = groups.table.column("info").take(pa.array(at)).combine_chunks()
        self.info = values.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        rest = groups.keep(~there & known[groups.of_row()])
        return Groups(rest.table, np.concatenate([[0], rest.start[1:][known]]))

    def part(self, name: str) -> np.ndarray:
        a, b = INFO[name]
        return self.info[:, a:b]

    def metric(self, name: str) -> tuple[np.ndarray, ...]:
        v = self.g.column(name).astype(float)
        present = ~np.isnan(v)
        low, high = RANGES[name]
        with np.errstate(invalid="ignore"):
            outside = present & ((v < low) | (v > high))
        constant = stuck(v, present, self.start)
        if self.info is not None:  # own rows by their series with what the neighbours add to it; the others as far as they are seen
            rows, series = np.flatnonzero(self.own), self.part("series_" + name)
            start = np.concatenate([[0], np.cumsum(np.bincount(self.gid[rows], minlength=self.groups))])
            constant[rows] = stuck(v[rows], present[rows], start, into=(series[:, 0], series[:, 1]), out_of=(series[:, 2], series[:, 3]))
        return v, present, outside, constant

    def path(self, name: str) -> tuple[np.ndarray, ...]:
        """The usable rows; their values, for places without the steps over what is missing; whether each follows directly on
        the one before; and what is outside its range or constant, of all rows."""
        v, present, outside, constant = self.metric(name)
        rows = np.flatnonzero(present & ~outside & ~constant)
        near = np.zeros(len(rows), bool)
        near[1:] = (self.gid[rows[1:]] == self.gid[rows[:-1]]) & (np.diff(self.frame[rows]) < 1.5 * self.stride[rows[1:]]) & (np.diff(rows) == 1)
        value = v[rows]
        if name != "speed" and len(rows):
            step = np.zeros(len(rows))
            step[1:] = np.where(near[1:], np.diff(value), 0.0)
            value = np.cumsum(step)
        return rows, value, near, outside, constant

    def grids(self, rows: np.ndarray, value: np.ndarray) -> list[Profiles]:
        return [Profiles(value, self.gid[rows], self.interval[rows], offset, self.groups) for offset in (0, PROFILE // 2)]

    def gram(self, grids: list[Profiles]) -> tuple[np.ndarray, np.ndarray]:
        gram, count = 0.0, 0
        chunk = self.chunk[np.minimum(self.start[:-1], self.n - 1)]
        for p in grids:
            own = chunk_of(p.begin // PROFILE, self.chunk_profiles) == chunk[p.gid]
            gram, count = gram + p.gram(own), count + np.bincount(p.gid[own], minlength=self.groups)
        return gram, count / 2


def rests(grids: list[Profiles], comps: np.ndarray) -> np.ndarray:
    a, b = (p.sparse(comps) for p in grids)
    return np.where(grids[0].central <= grids[1].central, a, b)


def far_of_source(cls: np.ndarray, value: np.ndarray, gid: np.ndarray, n_groups: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """For each group, from the classes of its residuals: the class beyond which they are far, and its largest value among
    the others."""
    q, factor = SCALES[name]
    middle = np.nan_to_num(grouped_quantile(cls, gid, n_groups, q))
    far = far_class(middle, factor, name)
    top = np.zeros(n_groups)
    plain = cls <= far[gid]
    np.maximum.at(top, gid[plain], value[plain])
    return far, top


def far_class(middle: np.ndarray, factor: float, name: str) -> np.ndarray:
    """middle: class of the residual at the quantile of the metric's scale."""
    return classes_of(FAR[name] * np.maximum(factor * LEAST_SCALE * WIDTH_OF_CLASS**middle, LEAST_SCALE))


def judge(c: Chunk) -> dict[str, np.ndarray]:
    """Kind of fault of each row and metric, -1 for none."""
    kinds = {}
    for name in RANGES:
        rows, value, near, outside, constant = c.path(name)
        spike = np.zeros(c.n, bool)
        if len(rows):
            grids = c.grids(rows, value)
            comps = components(*c.gram(grids)) if c.info is None else c.part("components_" + name).reshape(-1, PROFILE, RANK)
            off = rests(grids, comps)
            cls, own = classes_of(off), c.own[rows]
            if c.info is None:
                far, top = far_of_source(cls[own], value[own], c.gid[rows[own]], c.groups, name)
            else:
                far, top = c.part("far_" + name)[:, 0], c.part("usual_" + name)[:, 0]
            hit = cls > far[c.gid[rows]]
            spike[rows] = hit & (off > top[c.gid[rows]]) if name == "speed" else brief(off, hit, near)
        kinds[name] = np.select([outside, constant, spike], [0, 1, 2], -1)
    return kinds


# ---- passes: functions of groups of rows


def _first_pass(chunk_profiles: int):
    """Flags, as if each group were a whole source, and a row without frame for each group that has rows of its own."""

    def fn(groups: Groups) -> dict:
        c = Chunk(groups, chunk_profiles)
        kinds = judge(c)
        rows = np.flatnonzero(c.own & ((kinds["x"] >= 0) | (kinds["y"] >= 0) | (kinds["speed"] >= 0)))
        _, first = np.unique(c.gid[c.own], return_index=True)
        first = np.flatnonzero(c.own)[first]
        both = np.concatenate([rows, first])
        mark = np.arange(len(both)) >= len(rows)
        names = pa.array(KINDS)
        made = {f"{m}_fault": names.take(pa.array(kinds[m][both], mask=mark | (kinds[m][both] < 0))) for m in RANGES}
        return c.g.take(SOURCE, both) | {"frame": pa.array(c.frame[both], mask=mark)} | made | {"chunk": pa.array(c.chunk[both], mask=~mark)}

    return fn


def _sums(chunk_profiles: int):
    """Of each chunk: Gram matrices with their counts, and the constant series at its ends."""

    def fn(groups: Groups) -> dict:
        c = Chunk(groups, chunk_profiles)
        counts = np.bincount(c.gid[c.own], minlength=c.groups)
        some = np.flatnonzero(counts)
        grams, ends = [], []
        own = np.flatnonzero(c.own)
        begin = np.searchsorted(c.gid[own], some)
        for name in RANGES:
            rows, value, *_ = c.path(name)
            gram, count = c.gram(c.grids(rows, value)) if len(rows) else (np.zeros((c.groups, PROFILE, PROFILE)), np.zeros(c.groups))
            grams += [gram[some].reshape(len(some), -1), count[some, None]]
            v = c.g.column(name).astype(float)[own]
            for g, a in zip(some, begin):
                part = v[a : a + counts[g]]
                changes = np.flatnonzero(part[1:] != part[:-1])  # NaN differs from NaN
                there = ~np.isnan(part[[0, -1]])
                head, tail = (changes[0] + 1, len(part) - 1 - changes[-1]) if len(changes) else (len(part), len(part))
                ends.append([part[0], head * there[0], part[-1], tail * there[1], float(not len(changes) and there[0])])
        ends = np.nan_to_num(np.array(ends, float).reshape(len(RANGES), len(some), 5).transpose(1, 0, 2).reshape(len(some), -1))
        flat = np.hstack([*grams, ends])
        width = flat.shape[1]
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
        return c.g.take(SOURCE, own[begin]) | {"chunk": c.chunk[own[begin]], "v": values}

    return fn


def _of_source(groups: Groups) -> dict:
    """Components of the summed Gram matrices: rows (i, s) sorted by i."""
    size = PROFILE * PROFILE + 1
    sums = groups.column("s").reshape(len(groups), len(RANGES), size)
    comps = [components(sums[:, m, :-1].reshape(-1, PROFILE, PROFILE), sums[:, m, -1]).reshape(len(groups), -1) for m in range(len(RANGES))]
    return groups.take(SOURCE, groups.start[:-1]) | {"v": _lists(np.hstack(comps))}


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, float).ravel()))


def _classes(chunk_profiles: int):
    """Counts and largest values of the classes of residuals of each chunk, by the common components."""

    def fn(groups: Groups) -> dict:
        c = Chunk(groups, chunk_profiles)
        parts = []
        for m, name in enumerate(RANGES):
            rows, value, *_ = c.path(name)
            if len(rows):
                off = rests(c.grids(rows, value), c.part("components_" + name).reshape(-1, PROFILE, RANK))
                own = c.own[rows]
                cell, of, n = np.unique(c.gid[rows[own]] * CLASSES + classes_of(off[own]), return_inverse=True, return_counts=True)
                top = np.zeros(len(cell))
                np.maximum.at(top, of, value[own])
                parts.append((cell // CLASSES, np.full(len(cell), m), cell % CLASSES, n, top))
        g, m, k, n, top = (np.concatenate(p) for p in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
        return c.g.take(SOURCE, c.start[:-1][g]) | {"metric": m, "class": k, "n": n, "top": top.astype(float)}

    return fn


def _scales(groups: Groups) -> dict:
    """Class beyond which residuals are far, and usual top, of each metric, from the summed classes (rows sorted by class)."""
    gid, metric, cls, n, top = groups.of_row(), *(groups.column(c) for c in ("metric", "class", "n", "top"))
    made = []
    for m, name in enumerate(RANGES):
        q, factor = SCALES[name]
        rows = np.flatnonzero(metric == m)
        g = gid[rows]
        total = np.bincount(g, n[rows], len(groups)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(total)[:-1]])
        upto = np.cumsum(n[rows]) - before[g]
        at = np.flatnonzero(upto <= np.floor(q * np.maximum(total - 1, 0))[g])  # classes wholly below the quantile
        next_ = np.bincount(g[at], minlength=len(groups)) + np.searchsorted(g, np.arange(len(groups)))
        middle = np.where(total > 0, cls[rows][np.minimum(next_, len(rows) - 1)] if len(rows) else 0, 0)
        far = far_class(middle, factor, name)
        plain, most = cls[rows] <= far[g], np.zeros(len(groups))
        np.maximum.at(most, g[plain], top[rows][plain])
        made += [far[:, None], most[:, None]]
    return groups.take(SOURCE, groups.start[:-1]) | {"v": _lists(np.hstack(made))}


def _flags(chunk_profiles: int):
    def fn(groups: Groups) -> dict:
        c = Chunk(groups, chunk_profiles)
        kinds = judge(c)
        rows = np.flatnonzero(c.own & ((kinds["x"] >= 0) | (kinds["y"] >= 0) | (kinds["speed"] >= 0)))
        names = pa.array(KINDS)
        return c.g.take(SOURCE, rows) | {"frame": c.frame[rows]} | {f"{m}_fault": names.take(pa.array(kinds[m][rows], mask=kinds[m][rows] < 0)) for m in RANGES}

    return fn


#: What an info row holds, by place in its array.
INFO, _at = {}, 0
for _name, _size in [(f"components_{m}", PROFILE * RANK) for m in RANGES] + [(f"series_{m}", 4) for m in RANGES] + [(f"{k}_{m}", 1) for m in RANGES for k in ("far", "usual")]:
    INFO[_name] = (_at, _at + _size)
    _at += _size


def _neighbours(sums: DataFrame) -> DataFrame:
    """SOURCE, chunk, v: for each metric value and length of the constant series right before and right after the chunk."""
    first = len(RANGES) * (PROFILE * PROFILE + 1)
    at = lambda m, k: F.get("v", F.lit(first + 5 * m + k))
    ends = sums.select(*SOURCE, "chunk", *(at(m, k).alias(f"{n}{m}") for m in range(len(RANGES)) for k, n in enumerate(("hv", "hn", "tv", "tn", "whole"))))
    out = []
    for m in range(len(RANGES)):
        for way, (v, n, facing) in (("asc", ("tv", "tn", "hv")), ("desc", ("hv", "hn", "tv"))):
            order = F.col("chunk").asc() if way == "asc" else F.col("chunk").desc()
            w = Window.partitionBy(*SOURCE).orderBy(order)
            goes_on = (F.col(f"whole{m}") == 1) & (F.lag(f"{v}{m}").over(w) == F.col(f"{facing}{m}")) & (F.lag(f"{n}{m}").over(w) > 0)
            ends = ends.withColumn("__g", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
            ends = ends.withColumn("__s", F.sum(f"{n}{m}").over(Window.partitionBy(*SOURCE, "__g").orderBy(order)))
            ends = ends.withColumn(f"{way}{m}v", F.coalesce(F.lag(f"{v}{m}").over(w), F.lit(0.0))).withColumn(f"{way}{m}n", F.coalesce(F.lag("__s").over(w), F.lit(0.0))).drop("__g", "__s")
            out += [f"{way}{m}v", f"{way}{m}n"]
    return ends.select(*SOURCE, "chunk", F.array(*out).alias("ends"))


def _same(a: str, b: str, keys: list[str]):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _joined(a: DataFrame, b: DataFrame, keys: list[str], how: str, *columns: str) -> DataFrame:
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, _same("x", "y", keys), how).select("x.*", *(f"y.{c}" for c in columns))


def _of_long_sources(rows: DataFrame, chunk_profiles: int) -> DataFrame:
    """Flags of sources of more than one chunk, by their common components and scales."""
    keys, order = [*SOURCE, "chunk"], [F.col("frame").asc_nulls_first(), F.col("ingested_at").desc_nulls_last()]
    source = "game_id string, clip int, player string"
    run = lambda df, fn, ddl: map_sorted_groups(df, keys, order, fn, ddl)
    sums = cut_lineage(run(rows, _sums(chunk_profiles), f"{source}, chunk bigint, v array<double>"))
    cells = sums.select(*SOURCE, F.posexplode("v").alias("i", "s")).filter(F.col("i") < len(RANGES) * (PROFILE * PROFILE + 1)).groupBy(*SOURCE, "i").agg(F.sum("s").alias("s"))
    comps = map_sorted_groups(cells, SOURCE, ["i"], _of_source, f"{source}, v array<double>")
    known = cut_lineage(_joined(_neighbours(sums), comps, SOURCE, "inner", "v").select(*SOURCE, "chunk", F.concat("v", "ends").alias("info")))

    def informed(info: DataFrame) -> DataFrame:
        return rows.withColumn("info", F.lit(None).cast("array<double>")).unionByName(info.withColumn("own", F.lit(False)), allowMissingColumns=True)

    classes = run(informed(known), _classes(chunk_profiles), f"{source}, metric bigint, class bigint, n bigint, top double")
    classes = classes.groupBy(*SOURCE, "metric", "class").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    scales = map_sorted_groups(classes, SOURCE, ["metric", "class"], _scales, f"{source}, v array<double>")
    none = F.array_repeat(F.lit(0.0), 2 * len(RANGES))  # a source without a usable reading
    judged = _joined(known, scales, SOURCE, "left", "v").select(*SOURCE, "chunk", F.concat("info", F.coalesce("v", none)).alias("info"))
    return run(informed(judged), _flags(chunk_profiles), FLAGS)


def flag_faults(positions: DataFrame, games: DataFrame, chunk_profiles: int = CHUNK_PROFILES) -> DataFrame:
    """One row per faulty row: game_id, clip, player, frame, x_fault, y_fault, speed_fault (range, stuck, spike or NULL)."""
    rows = lookup(of_sources(positions).select(*SOURCE, "frame", "x", "y", "speed", "ingested_at"), game_strides(games), ["game_id"])
    rows = rows.withColumn("stride", F.coalesce("stride", F.lit(1)))
    shifted = F.floor(F.floor(F.col("frame") / F.col("stride")) / PROFILE) + chunk_profiles // 2
    home, at = F.floor(shifted / chunk_profiles), F.pmod(shifted, F.lit(chunk_profiles))
    near = F.array(home, F.when(at < HALO, home - 1), F.when(at >= chunk_profiles - HALO, home + 1))
    rows = rows.withColumn("chunk", F.explode(F.filter(near, lambda c: c.isNotNull()))).withColumn("own", F.col("chunk") == home)
    order = ["frame", F.col("ingested_at").desc_nulls_last()]
    seen = cut_lineage(map_sorted_groups(rows, [*SOURCE, "chunk"], order, _first_pass(chunk_profiles), FLAGS + ", chunk bigint"))
    flags = seen.filter("chunk IS NULL").drop("chunk")
    long = seen.filter("chunk IS NOT NULL").groupBy(*SOURCE).agg(F.count("*").alias("n")).filter("n > 1").select(*SOURCE)
    if not long.limit(1).count():
        return flags
    long = cut_lineage(long)
    again = _of_long_sources(_joined(rows, long, SOURCE, "left_semi"), chunk_profiles)
    return _joined(flags, long, SOURCE, "left_anti").unionByName(again)
