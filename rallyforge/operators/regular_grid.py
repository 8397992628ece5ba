"""Problem 4: irregular readings onto a regular grid, with missing periods marked and filled.

Method: a Kalman smoother with a continuous-time local trend for each source. State: place and velocity; between two
times dt apart the velocity takes a Wiener step of intensity q, so the transition and its noise follow from dt alone
and readings may come at any times. The filter visits the readings, the backward (Rauch-Tung-Striebel) pass gives place,
velocity and covariance at each of them from all readings. Between two readings the trend is a bridge: given both ends
its mean is the cubic with their places and velocities, and its variance has a closed form as well. So the middles of the
grid's periods are evaluated from the two readings around them, without a recursion over periods. x and y have the same
times and noise, hence one covariance serves both. A reading whose innovation exceeds ``GATE`` deviations is given a
larger noise in proportion, so an outlier does not drag the filled values.

Scale: the table is read and shuffled once, by source and chunk of ``CHUNK_FRAMES`` frames; a source in one chunk, the rule,
is smoothed there. What is not a period with readings comes out as a hole, one row with the states at its ends however long
it is; the JVM makes periods of it, long holes in slices of ``SLICE_PERIODS`` that are spread over tasks first. So a clock
that jumps costs the rows of its missing periods, and no task holds them. Sources of several chunks are found among the
chunks seen, and done again by blocks of ``BLOCK_PERIODS`` periods: a block also sees the readings within ``HALO_PERIODS``
of its ends, and the nearest reading of the blocks before and after however far that is. Which periods are missing does
not depend on blocks at all, filled values not beyond what the trend forgets in the halo; the noise of a reading is
that of the whole source. The sources of a task run in lockstep: one numpy step serves all.

Defined results: rows without player or frame belong to no source; of rows with an equal key the newest counts. A
reading has t, x and y present (not NULL, not NaN) and ``interpolated`` not true; an infinite t, or one beyond
``MOST_SECONDS``, is no place on a grid and no reading; an infinite x or y counts as a reading but does not enter the
smoother. A source gets the periods from its first to its last reading; a source without readings gets none. Period k is
k/2 <= t < (k+1)/2. A source whose readings are all infinite has NULL values.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.operators.grouped import Groups, map_sorted_groups, newest_of_key
from rallyforge.session import sized, stored
from rallyforge.sources.tables import of_sources

SOURCE = ["game_id", "clip", "player"]
PERIOD = 0.5
CHUNK_FRAMES, BLOCK_PERIODS, HALO_PERIODS, SLICE_PERIODS = 32_768, 4_096, 64, 4_096
#: Times beyond this are no place on the grid (half seconds must be countable in a bigint).
MOST_SECONDS = 4e18
#: Intensity of the velocity's noise (m^2/s^3), least and greatest deviation of a reading (m), gate in deviations.
INTENSITY, LEAST_NOISE, MOST_NOISE, GATE = 4.0, 0.02, 0.5, 4.0
#: Second differences are told apart in classes of 1 %, from this size up.
LEAST_SECOND, WIDTH_OF_CLASS, CLASSES = 1e-4, 1.01, 2_048
ID = "game_id string, clip int, player string"
#: A period with readings; or a hole (last_no set): its first and last period, and the states at its ends; or a chunk seen.
PART = f"{ID}, period_no bigint, last_no bigint, x double, y double, sd double, n_readings bigint, ends array<double>, chunk bigint"


def smooth(time: np.ndarray, xy: np.ndarray, seen: np.ndarray, noise: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed places (n, 2) and their variance (n) of states."""
    place, _, cov, _ = states(time, xy, seen, noise, start)
    return place, np.maximum(cov[:, 0], 0.0)


def states(time: np.ndarray, xy: np.ndarray, seen: np.ndarray, noise: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Kalman smoother over all groups in lockstep. time: sorted in each group; seen: rows with a reading in xy (n, 2);
    noise: deviation of a reading of each group. Returns smoothed places and velocities (n, 2), their covariance (n, 3:
    place, mixed, velocity), and the covariance of each state with the one of the next row (n, 4: place with place,
    place with velocity, velocity with place, velocity with velocity)."""
    n, size = len(time), np.diff(start)
    if not n:
        return np.zeros((0, 2)), np.zeros((0, 2)), np.zeros((0, 3)), np.zeros((0, 4))
    order = np.argsort(-size, kind="stable")  # longest first: those still running are a prefix
    begin, size = start[:-1][order], size[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), side="left")
    r0 = noise[order] ** 2
    m, v = np.zeros((n, 2)), np.zeros((n, 2))  # filtered place and velocity
    p = np.zeros((n, 3))  # filtered covariance: place, mixed, velocity
    k = len(size)
    x, u = np.zeros((k, 2)), np.zeros((k, 2))
    a, b, c = np.full(k, 1e4), np.zeros(k), np.full(k, 25.0)
    before = np.zeros(k)
    for s in range(steps):
        w = alive[s]
        row = begin[:w] + s
        t = time[row]
        dt = (t - before[:w]) if s else np.zeros(w)
        before[:w] = t
        xs = x[:w] + u[:w] * dt[:, None]
        us = u[:w]
        cs = c[:w] + INTENSITY * dt
        bs = b[:w] + c[:w] * dt + INTENSITY * dt * dt / 2
        as_ = a[:w] + dt * (2 * b[:w] + c[:w] * dt) + INTENSITY * dt**3 / 3
        has = seen[row]
        off = np.where(has[:, None], xy[row] - xs, 0.0)
        r = r0[:w]
        with np.errstate(over="ignore"):  # infinitely far: no weight
            far = (off**2).max(axis=1) / ((as_ + r) * GATE**2)
            r = r * np.maximum(far, 1.0) ** 2
        gain = np.where(has, 1.0 / (as_ + r), 0.0)
        ga, gb = as_ * gain, bs * gain
        x[:w], u[:w] = xs + ga[:, None] * off, us + gb[:, None] * off
        c[:w] = cs - gb * bs
        b[:w] = bs - ga * bs
        a[:w] = as_ - ga * as_
        m[row], v[row] = x[:w], u[:w]
        p[row, 0], p[row, 1], p[row, 2] = a[:w], b[:w], c[:w]
    place, speed, cov, mixed = m.copy(), v.copy(), p.copy(), np.zeros((n, 4))
    last = begin + size - 1
    x, u = m[last], v[last]
    a, b, c = (p[last, j].copy() for j in range(3))
    after = time[last].copy()
    for s in range(steps - 2, -1, -1):
        w = alive[s + 1] if s + 1 < steps else 0  # groups with a row after this one
        row = begin[:w] + s
        dt = after[:w] - time[row]
        after[:w] = time[row]
        fa, fb, fc = p[row, 0], p[row, 1], p[row, 2]
        pc = fc + INTENSITY * dt
        pb = fb + fc * dt + INTENSITY * dt * dt / 2
        pa_ = fa + dt * (2 * fb + fc * dt) + INTENSITY * dt**3 / 3
        det = np.maximum(pa_ * pc - pb * pb, 1e-12)
        la, lb = fa + fb * dt, fb + fc * dt  # filtered covariance times the transition, first column; second: fb, fc
        g00, g01 = (la * pc - fb * pb) / det, (fb * pa_ - la * pb) / det
        g10, g11 = (lb * pc - fc * pb) / det, (fc * pa_ - lb * pb) / det
        same = dt <= 1e-9  # two rows at one time share their state
        g00, g01 = np.where(same, 1.0, g00), np.where(same, 0.0, g01)
        g10, g11 = np.where(same, 0.0, g10), np.where(same, 1.0, g11)
        dx, du = x[:w] - (m[row] + v[row] * dt[:, None]), u[:w] - v[row]
        x[:w] = m[row] + g00[:, None] * dx + g01[:, None] * du
        u[:w] = v[row] + g10[:, None] * dx + g11[:, None] * du
        na, nb, nc = a[:w].copy(), b[:w].copy(), c[:w].copy()  # of the next row
        mixed[row] = np.stack([g00 * na + g01 * nb, g00 * nb + g01 * nc, g10 * na + g11 * nb, g10 * nb + g11 * nc], axis=1)
        da, db, dc = na - pa_, nb - pb, nc - pc
        a[:w] = fa + g00 * (g00 * da + g01 * db) + g01 * (g00 * db + g01 * dc)
        b[:w] = fb + g10 * (g00 * da + g01 * db) + g11 * (g00 * db + g01 * dc)
        c[:w] = fc + g10 * (g10 * da + g11 * db) + g11 * (g10 * db + g11 * dc)
        place[row], speed[row] = x[:w], u[:w]
        cov[row] = np.stack([a[:w], b[:w], c[:w]], axis=1)
    return place, speed, cov, mixed


def second_classes(xy: np.ndarray, gid: np.ndarray) -> np.ndarray:
    """Class of the second difference (the larger of x and y) around each reading; -1 at the ends of a group."""
    out = np.full(len(xy), -1, np.int64)
    if len(xy) > 2:
        with np.errstate(over="ignore", invalid="ignore"):
            second = np.abs(xy[2:] - 2 * xy[1:-1] + xy[:-2]).max(axis=1)
            size = np.maximum(np.nan_to_num(second, nan=np.inf) / LEAST_SECOND, 1.0)
            cls = np.minimum(np.ceil(np.log(size) / np.log(WIDTH_OF_CLASS)), CLASSES - 1).astype(np.int64)
        inside = gid[2:] == gid[:-2]
        out[1:-1][inside] = cls[inside]
    return out


def noise_of(middle: np.ndarray) -> np.ndarray:
    """Deviation of a source's readings from the class of its median second difference, so spikes do not count."""
    known = ~np.isnan(middle)
    size = LEAST_SECOND * WIDTH_OF_CLASS ** np.where(known, middle, 0)
    return np.where(known, np.clip(size / (0.6745 * np.sqrt(6.0)), LEAST_NOISE, MOST_NOISE), LEAST_NOISE)


def median_classes(cls: np.ndarray, gid: np.ndarray, n_groups: int) -> np.ndarray:
    from rallyforge.operators.spikes import grouped_quantile

    return grouped_quantile(cls[cls >= 0], gid[cls >= 0], n_groups, 0.5)


class Trend:
    """Smoothed states of the usable readings of groups, to be evaluated at any times."""

    def __init__(self, t: np.ndarray, xy: np.ndarray, gid: np.ndarray, n_groups: int, noise: np.ndarray):
        usable = np.isfinite(xy).all(axis=1)
        self.t, self.gid = t[usable], gid[usable]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.gid, minlength=n_groups))])
        self.place, self.speed, self.cov, self.mixed = states(self.t, xy[usable], np.ones(len(self.t), bool), noise, self.start)

    def ends(self, gid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each time of a group (in order) what it depends on: way (0 between two readings, 1 after the last, -1 before the
        first, NaN: the group has none), time of the reading before (else of the only one), distance to the next, x and its
        velocity, the same at the next, y likewise, and the ten covariances of (place, velocity) here and there."""
        both = np.concatenate([self.gid, gid])
        order = np.lexsort((np.concatenate([np.zeros(len(self.t), bool), np.ones(len(at), bool)]), np.concatenate([self.t, at]), both))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        last = np.cumsum(order < len(self.t))[back[len(self.t) :]] - 1  # reading at or before
        first, stop = self.start[gid], self.start[gid + 1]
        way = np.where(first == stop, np.nan, np.where(last < first, -1.0, np.where(last + 1 >= stop, 1.0, 0.0)))
        if not len(self.t):
            return np.column_stack([way, np.full((len(at), 20), np.nan)])
        a = np.clip(np.where(way == -1, first, last), 0, len(self.t) - 1)
        b = np.where(way == 0, a + 1, a)
        x, y = (np.stack([self.place[a, k], self.speed[a, k], self.place[b, k], self.speed[b, k]], axis=1) for k in (0, 1))
        return np.column_stack([way, self.t[a], self.t[b] - self.t[a], x, y, self.cov[a], self.mixed[a], self.cov[b]])


def bridge(e, at, f=np) -> tuple:
    """x, y and variance at a time, from its ends (columns as in Trend.ends); f: numpy, or functions of Columns."""
    pick = (lambda c, x, y: np.where(c, x, y)) if f is np else (lambda c, x, y: F.when(c, x).otherwise(y))
    way, ta = e[0], e[1]
    dt = pick(e[2] == 0, np.nan if f is np else F.lit(float("nan")), e[2])
    tau = at - ta
    u = tau / dt
    h = (2 * u * u * u - 3 * u * u + 1, (u * u * u - 2 * u * u + u) * dt, 3 * u * u - 2 * u * u * u, (u * u * u - u * u) * dt)
    between = way == 0
    place = [pick(between, sum(h[k] * e[i + k] for k in range(4)), e[i] + e[i + 1] * tau) for i in (3, 7)]
    aa, ab, bb, ac, ad, bc, bd, cc, cd, dd = (e[11 + k] for k in range(10))
    given = (
        h[0] * h[0] * aa + h[1] * h[1] * bb + h[2] * h[2] * cc + h[3] * h[3] * dd
        + 2 * (h[0] * h[1] * ab + h[0] * h[2] * ac + h[0] * h[3] * ad + h[1] * h[2] * bc + h[1] * h[3] * bd + h[2] * h[3] * cd)
    )
    rest = dt - tau
    inner = INTENSITY / 3 * (tau * rest / dt) * (tau * rest / dt) * (tau * rest / dt)
    far = f.abs(tau)
    outer = aa + 2 * tau * ab + tau * tau * bb + INTENSITY / 3 * far * far * far
    return place[0], place[1], pick(between, given + inner, outer)


def _parts(groups: Groups, rows: np.ndarray, t: np.ndarray, xy: np.ndarray, gid: np.ndarray, own: np.ndarray, noise: np.ndarray) -> dict:
    """Periods with readings and holes of each group. rows: a row of the groups' table behind each reading; readings are
    sorted by group and time; own: those that the group answers for, together with the hole after each."""
    period = np.floor(t / PERIOD).astype(np.int64)
    trend = Trend(t, xy, gid, len(groups), noise)
    new = np.ones(len(t), bool)
    new[1:] = (gid[1:] != gid[:-1]) | (period[1:] != period[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(t)))
    mine = own[first]
    g, p = gid[first], period[first]
    hole = np.zeros(len(first), bool)
    if len(first) > 1:
        hole[:-1] = mine[:-1] & (g[1:] == g[:-1]) & (p[1:] > p[:-1] + 1)
    seen, before = np.flatnonzero(mine), np.flatnonzero(hole)
    middle = (p[seen] + 0.5) * PERIOD
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        x, y, variance = bridge(trend.ends(g[seen], middle).T, middle)
    ends = trend.ends(g[before], (p[before] + 1.5) * PERIOD)
    n, m = len(seen), len(before)
    none, blank = np.ones(m, bool), np.concatenate([np.zeros(n, bool), np.ones(m, bool)])
    value = lambda v: pa.array(np.concatenate([np.round(v, 4), np.zeros(m)]), mask=np.concatenate([~np.isfinite(v), none]))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(n + 1, np.int64), np.arange(1, m + 1) * 21]).astype(np.int32)), pa.array(ends.ravel()))
    return groups.take(SOURCE, rows[first[np.concatenate([seen, before])]]) | {
        "period_no": np.concatenate([p[seen], p[before] + 1]), "last_no": pa.array(np.concatenate([np.zeros(n, np.int64), p[np.minimum(before + 1, len(p) - 1)] - 1]), mask=~blank),
        "x": value(x), "y": value(y), "sd": value(np.sqrt(np.maximum(variance, 0.0))), "n_readings": np.concatenate([count[seen], np.zeros(m, np.int64)]), "ends": lists,
        "chunk": pa.nulls(n + m, pa.int64()),
    }


def _whole(groups: Groups) -> dict:
    """Parts, as if each group (source and chunk of frames) were a whole source; and a row for each group."""
    g = newest_of_key(groups)
    rows = np.flatnonzero(g.column("reading"))
    t, gid = g.column("t").astype(float)[rows], g.of_row()[rows]
    xy = np.stack([g.column("x").astype(float), g.column("y").astype(float)], axis=1)[rows]
    noise = noise_of(median_classes(second_classes(xy, gid), gid, len(g)))
    order = np.lexsort((t, gid))  # stable: frames decide
    made = _parts(g, rows[order], t[order], xy[order], gid, np.ones(len(rows), bool), noise)
    first = g.start[:-1][np.diff(g.start) > 0]
    k = len(first)
    no = lambda kind: pa.nulls(k, kind)
    of_groups = g.take(SOURCE, first) | {
        "period_no": no(pa.int64()), "last_no": no(pa.int64()), "x": no(pa.float64()), "y": no(pa.float64()), "sd": no(pa.float64()), "n_readings": no(pa.int64()),
        "ends": no(pa.list_(pa.float64())), "chunk": g.column("chunk").astype(np.int64)[first],
    }
    both = pa.concat_tables([pa.table(made), pa.table(of_groups)])
    return {c: both.column(c) for c in both.column_names}


def _newest(groups: Groups) -> dict:
    """The readings among the newest versions; the versions are chosen before, so that an older reading cannot stand in
    for a newer row that is none. With the class of the second difference around each in its chunk."""
    g = newest_of_key(groups)
    rows = np.flatnonzero(g.column("reading"))
    xy = np.stack([g.column("x").astype(float), g.column("y").astype(float)], axis=1)[rows]
    return g.take([*SOURCE, "frame", "t", "x", "y"], rows) | {"second": second_classes(xy, g.of_row()[rows])}


def _noise(groups: Groups) -> dict:
    """Noise of each source from the counts (n) of its classes (second), sorted."""
    gid, cls, n = groups.of_row(), groups.column("second"), groups.column("n")
    total = np.bincount(gid, n, len(groups)).astype(np.int64)
    upto = np.cumsum(n) - np.concatenate([[0], np.cumsum(total)[:-1]])[gid]
    below = np.bincount(gid[upto <= np.floor(0.5 * np.maximum(total - 1, 0))[gid]], minlength=len(groups))
    return groups.take(SOURCE, groups.start[:-1]) | {"noise": noise_of(cls[groups.start[:-1] + below].astype(float))}


def _block(groups: Groups) -> dict:
    """Parts of blocks: rows sorted by time, own ones and neighbours."""
    t, gid = groups.column("t").astype(float), groups.of_row()
    xy = np.stack([groups.column("x").astype(float), groups.column("y").astype(float)], axis=1)
    noise = groups.column("noise").astype(float)[groups.start[:-1]]
    return _parts(groups, np.arange(len(t)), t, xy, gid, groups.column("own").astype(bool), noise)


def _same(a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in SOURCE])


def _blocks(readings: DataFrame, block_periods: int, halo_periods: int) -> DataFrame:
    """Each reading with the block it belongs to, and once more for a neighbour whose end it is near to; and the nearest
    readings of the blocks before and after."""
    shifted = F.floor(F.col("t") / PERIOD) + block_periods // 2  # clips start at small times, so no block ends at 0
    home, at = F.floor(shifted / block_periods), F.pmod(shifted, F.lit(block_periods))
    halo = min(halo_periods, block_periods)
    blocks = F.array(home, F.when(at < halo, home - 1), F.when(at >= block_periods - halo, home + 1))
    placed = readings.withColumn("block", F.explode(F.filter(blocks, lambda c: c.isNotNull()))).withColumn("own", F.col("block") == home)
    reading = F.struct("frame", "t", "x", "y", "noise")
    ends = readings.withColumn("block", home).groupBy(*SOURCE, "block").agg(F.min_by(reading, F.struct("t", "frame")).alias("head"), F.max_by(reading, F.struct("t", "frame")).alias("tail"))
    w = Window.partitionBy(*SOURCE).orderBy("block")
    far = (
        ends.withColumn("before", F.lag("tail").over(w)).withColumn("after", F.lead("head").over(w))
        .select(*SOURCE, "block", F.explode(F.array("before", "after")).alias("r")).filter("r IS NOT NULL")
        .select(*SOURCE, "r.*", "block", F.lit(False).alias("own"))
    )
    # a reading near the end is there twice: equal rows without an own one, of which one is enough
    return placed.unionByName(far).dropDuplicates([*SOURCE, "block", "frame", "t"])


def _of_long_sources(rows: DataFrame, block_periods: int, halo_periods: int) -> DataFrame:
    order = ["frame", F.col("ingested_at").desc_nulls_last()]
    readings = stored(map_sorted_groups(rows, [*SOURCE, "chunk"], order, _newest, f"{ID}, frame bigint, t double, x double, y double, second bigint"))
    counts = readings.filter("second >= 0").groupBy(*SOURCE, "second").agg(F.count("*").alias("n"))
    noise = sized(stored(map_sorted_groups(counts, SOURCE, ["second"], _noise, f"{ID}, noise double")))
    known = readings.alias("a").join(noise.alias("b"), _same("a", "b"), "left").select("a.*", F.coalesce("b.noise", F.lit(LEAST_NOISE)).alias("noise")).drop("second")
    return map_sorted_groups(_blocks(known, block_periods, halo_periods), [*SOURCE, "block"], ["t", "frame"], _block, PART)


def _periods(parts: DataFrame) -> DataFrame:
    """Periods with readings as they are, holes made into periods."""
    seen = parts.filter("last_no IS NULL").select(*SOURCE, "period_no", "x", "y", "sd", "n_readings", F.lit(False).alias("missing"))
    holes = parts.filter("last_no IS NOT NULL").withColumn("slices", F.floor((F.col("last_no") - F.col("period_no")) / SLICE_PERIODS))
    # slices of long holes are spread over tasks before they become periods
    long = holes.filter("slices > 0").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("bigint"), "slices"))).withColumn("period_no", F.col("period_no") + F.col("slice") * SLICE_PERIODS)
    long = long.withColumn("last_no", F.least("last_no", F.col("period_no") + (SLICE_PERIODS - 1))).drop("slice").repartition(*SOURCE, "period_no")
    each = holes.filter("slices = 0").unionByName(long).withColumn("period_no", F.explode(F.sequence("period_no", "last_no")))
    x, y, variance = bridge([F.get("ends", F.lit(i)) for i in range(21)], (F.col("period_no") + F.lit(0.5)) * PERIOD, F)
    known = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 4))
    filled = each.select(*SOURCE, "period_no", known(x).alias("x"), known(y).alias("y"), known(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sd"), "n_readings", F.lit(True).alias("missing"))
    return seen.unionByName(filled)


def regular_grid(positions: DataFrame, block_periods: int = BLOCK_PERIODS, halo_periods: int = HALO_PERIODS, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """One row per source and period: game_id, clip, player, period_no, t (middle), x, y, sd (of either), n_readings,
    missing, interpolated (true where no true reading stands behind the values)."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = of_sources(positions).select(
        *SOURCE, "frame", "t", "x", "y", "ingested_at", F.floor((F.col("frame") + chunk_frames // 2) / chunk_frames).alias("chunk"),
        (good("t") & good("x") & good("y") & ~F.coalesce("interpolated", F.lit(False)) & (F.abs("t") < MOST_SECONDS)).alias("reading"),
    )
    parts = stored(map_sorted_groups(rows, [*SOURCE, "chunk"], ["frame", F.col("ingested_at").desc_nulls_last()], _whole, PART))
    long = parts.filter("chunk IS NOT NULL").groupBy(*SOURCE).agg(F.count("*").alias("n")).filter("n > 1").select(*SOURCE)
    parts = parts.filter("chunk IS NULL")
    if long.limit(1).count():
        long = sized(stored(long))
        again = _of_long_sources(rows.alias("a").join(long.alias("b"), _same("a", "b"), "left_semi"), block_periods, halo_periods)
        parts = parts.alias("a").join(long.alias("b"), _same("a", "b"), "left_anti").unionByName(stored(again))
    return _periods(parts).select(*SOURCE, "period_no", ((F.col("period_no") + F.lit(0.5)) * PERIOD).alias("t"), "x", "y", "sd", "n_readings", "missing", F.col("missing").alias("interpolated"))
