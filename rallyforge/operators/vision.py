"""Numeric parts of calibration: robust lines, runs of edge points, background, line tracing, homography and lens.

Inputs are tables of points or pixels; decoding of pictures is a source's business. What works on a handful of lines or
corners is plain numpy, to be called on the driver or inside a grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def robust_line(x: np.ndarray, y: np.ndarray, tolerance: float = 2.0, rounds: int = 800, seed: int = 0) -> tuple[float, float, float]:
    """Slope, intercept and inlier share of the line with most points within the tolerance, by random pairs, all of them
    tried at once, then least squares over its inliers."""
    rng = np.random.default_rng(seed)
    i, j = rng.integers(0, len(x), (2, rounds))
    use = np.abs(x[j] - x[i]) >= 1
    if not use.any():
        return float("nan"), float("nan"), 0.0
    i, j = i[use], j[use]
    a = (y[j] - y[i]) / (x[j] - x[i])
    b = y[i] - a * x[i]
    hits = np.abs(y[None, :] - (a[:, None] * x[None, :] + b[:, None])) < tolerance
    best = hits[hits.sum(axis=1).argmax()]
    slope, intercept = np.polyfit(x[best], y[best], 1)
    return float(slope), float(intercept), float(best.mean())


def robust_lines(points: DataFrame, keys: list[str], tolerance: float = 2.0, rounds: int = 800) -> DataFrame:
    """keys..., slope, intercept, inlier_share of the points (x, y) of each group."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        line = robust_line(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), tolerance, rounds)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *line]], columns=[*keys, "slope", "intercept", "inlier_share"])

    clean = points.filter("x IS NOT NULL AND y IS NOT NULL").select(*keys, "x", "y")
    return clean.groupBy(*keys).applyInPandas(fn, f"{ddl}, slope double, intercept double, inlier_share double")


def background(pixels: DataFrame, keys: tuple[str, ...] = ("py", "px", "channel"), value: str = "v") -> DataFrame:
    """keys..., v: the exact median over the frames of each pixel and channel."""
    return pixels.groupBy(*keys).agg(F.median(value).alias(value))


def edge_runs(xs: np.ndarray, gap: int = 6, least: int = 20) -> list[tuple[int, int]]:
    """First and last of the runs of sorted places with no step beyond the gap, at least so long."""
    if not len(xs):
        return []
    cut = np.flatnonzero(np.diff(xs) > gap) + 1
    return [(int(r[0]), int(r[-1])) for r in np.split(xs, cut) if r[-1] - r[0] >= least]


def trace(score: DataFrame, along: str, across: str, value: str = "v", least: float = 20.0) -> DataFrame:
    """along, across: the strongest place on each scan line, if it is strong enough and not at the band's edge."""
    best = score.groupBy(along).agg(F.max_by(across, F.struct(value, -F.col(across))).alias(across), F.max(value).alias(value), F.min(across).alias("a"), F.max(across).alias("b"))
    return best.filter((F.col(value) >= least) & (F.col(across) > F.col("a")) & (F.col(across) < F.col("b"))).select(along, across)


def intersections(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> list[tuple[int, int, float, float]]:
    """Where lines y = m x + c of a meet those of b; parallel ones do not."""
    return [(i, j, (d - c) / (m - k), m * (d - c) / (m - k) + c) for i, (m, c) in enumerate(a) for j, (k, d) in enumerate(b) if m != k]


def homography(pixels: np.ndarray, court: np.ndarray) -> np.ndarray:
    """3 x 3 matrix from at least four pairs of points, by least squares on the direct linear form, h22 = 1."""
    rows, right = [], []
    for (u, v), (x, y) in zip(pixels, court):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
        right += [x, y]
    h = np.linalg.lstsq(np.array(rows, float), np.array(right, float), rcond=None)[0]
    return np.append(h, 1.0).reshape(3, 3)


def fit_lens(pixels: np.ndarray, court: np.ndarray, centre: tuple[float, float], r0: float, grid: int = 81) -> tuple[float, np.ndarray, float]:
    """k of the division model and the homography with the least rms error in court metres: the homography is solved for
    each k, and k is searched on an ever finer grid."""
    c = np.array(centre)
    v = pixels - c
    r2 = (v**2).sum(axis=1) / r0**2

    def at(k: float) -> tuple[float, np.ndarray]:
        h = homography(c + v / (1 + k * r2)[:, None], court)
        p = np.c_[c + v / (1 + k * r2)[:, None], np.ones(len(v))] @ h.T
        return float(np.sqrt((((p[:, :2] / p[:, 2:]) - court) ** 2).sum(axis=1).mean())), h

    low, high = -0.6, 0.6
    for _ in range(5):
        ks = np.linspace(low, high, grid)
        k = ks[int(np.argmin([at(x)[0] for x in ks]))]
        width = ks[1] - ks[0]
        low, high = k - width, k + width
    rms, h = at(k)
    return float(k), h, rms


#: Loss of a residual r (metres): 2 f^2 (sqrt(1 + (r / f)^2) - 1), quadratic up to about f and linear beyond.
SOFT_M = 0.1
#: Corners count where both traces come within so many pixels of them; lenses that the search starts from.
CORNER_PX, LENS_STARTS = 25.0, (-0.3, -0.15, 0.0, 0.15)


def total_line(points: np.ndarray) -> np.ndarray:
    """a, b, c of the line a x + b y + c = 0 with the least squared distance from the points."""
    centre = points.mean(axis=0)
    normal = np.linalg.eigh(np.cov((points - centre).T))[1][:, 0]
    return np.append(normal, -normal @ centre)


def corners(lines: dict[str, tuple[np.ndarray, str, float]]) -> list[tuple[np.ndarray, tuple[float, float]]]:
    """Pixel and court place of each meeting of a line of constant x with one of constant y, near to both traces."""
    out = []
    across, along = ([(p, v, total_line(p)) for p, a, v in lines.values() if a == axis and len(p) >= 4] for axis in "xy")
    for px, x, first in across:
        for py, y, second in along:
            at = np.cross(first, second)
            if abs(at[2]) > 1e-9:
                spot = at[:2] / at[2]
                if max(np.hypot(*(trace - spot).T).min() for trace in (px, py)) < CORNER_PX:
                    out.append((spot, (x, y)))
    return out


class FloorFit:
    """Homography and lens (division model around `centre`, radii in r0) from traced lines and known places.

    lines: name -> (pixels, the axis that is constant along it, its value in metres); places: name -> (pixel, court place,
    weight). In coordinates (pixel - centre) / r0 the floor is H applied to v / (1 + k v^2); nine numbers are found by damped
    Gauss-Newton steps on the soft loss, from several lenses and the homography of the corners."""

    def __init__(self, lines: dict[str, tuple[np.ndarray, str, float]], places: dict[str, tuple[np.ndarray, tuple[float, float], float]], centre: tuple[float, float], r0: float):
        self.lines, self.places, self.centre, self.r0 = lines, places, np.array(centre, float), r0
        pixels = [p for p, _, _ in lines.values()] + [np.array([p]) for p, _, _ in places.values()]
        self.v = (np.concatenate(pixels) - self.centre) / r0
        on_x = np.concatenate([np.full(len(p), a == "x") for p, a, _ in lines.values()] or [np.zeros(0, bool)])
        value = np.concatenate([np.full(len(p), v) for p, _, v in lines.values()] or [np.zeros(0)])
        m = len(on_x)
        # residual i is coordinate axis[i] of point row[i] less goal[i], by weight[i]
        k = np.arange(len(places)) + m
        self.row = np.concatenate([np.arange(m), np.repeat(k, 2)])
        self.axis = np.concatenate([np.where(on_x, 0, 1), np.tile([0, 1], len(places))]).astype(int)
        self.goal = np.concatenate([value, np.array([w for _, w, _ in places.values()], float).ravel()])
        self.weight = np.concatenate([np.ones(m), np.repeat([w for _, _, w in places.values()], 2)])
        found = corners(lines) + [(np.asarray(p, float), w) for p, w, _ in places.values()]
        if len(found) < 4:
            raise ValueError("fewer than four corners and known places")
        spots, goals = (np.array(c, float) for c in zip(*found))
        start = homography((spots - self.centre) / r0, goals).ravel()[:8]
        self.h, self.k, self.cost = None, 0.0, np.inf
        for lens in LENS_STARTS:
            theta, cost = self._descend(np.append(start, lens))
            if cost < self.cost:
                self.h, self.k, self.cost = np.append(theta[:8], 1.0).reshape(3, 3), float(theta[8]), cost

    def _court(self, theta: np.ndarray, v: np.ndarray) -> np.ndarray:
        q = np.c_[v / (1 + theta[8] * (v**2).sum(axis=1))[:, None], np.ones(len(v))] @ np.append(theta[:8], 1.0).reshape(3, 3).T
        return q[:, :2] / q[:, 2:]

    def _off(self, theta: np.ndarray) -> np.ndarray:
        return (self._court(theta, self.v)[self.row, self.axis] - self.goal) * self.weight

    def _descend(self, theta: np.ndarray, most: int = 200) -> tuple[np.ndarray, float]:
        loss = lambda r: float((2 * SOFT_M**2 * (np.sqrt(1 + (r / SOFT_M) ** 2) - 1)).sum())
        damping, off = 1e-3, self._off(theta)
        cost = loss(off)
        for _ in range(most):
            step = 1e-6 * np.maximum(np.abs(theta), 1e-2)
            slope = np.stack([(self._off(theta + e) - self._off(theta - e)) / (2 * d) for d, e in zip(step, np.diag(step))], axis=1)
            w = 1 / np.sqrt(1 + (off / SOFT_M) ** 2)
            normal, pull = slope.T @ (slope * w[:, None]), slope.T @ (w * off)
            while damping < 1e12:
                trial = theta - np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), pull)
                tried = self._off(trial)
                if np.isfinite(tried).all() and loss(tried) < cost:
                    break
                damping *= 4
            else:
                return theta, cost
            gain, theta, off, cost, damping = cost - loss(tried), trial, tried, loss(tried), damping / 3
            if gain < 1e-12 * max(cost, 1e-12):
                break
        return theta, cost

    def to_court(self, pixels: np.ndarray) -> np.ndarray:
        return self._court(np.append(self.h.ravel()[:8], self.k), (np.asarray(pixels, float) - self.centre) / self.r0)

    def quality(self) -> dict[str, tuple[int, float, float]]:
        """For each line: pixels, root mean square and largest error in metres; for each place: 1 and its error twice."""
        out = {}
        for name, (pixels, axis, value) in self.lines.items():
            e = self.to_court(pixels)[:, 0 if axis == "x" else 1] - value
            out[name] = (len(e), float(np.sqrt((e**2).mean())), float(np.abs(e).max()))
        for name, (pixel, goal, _) in self.places.items():
            e = float(np.hypot(*(self.to_court(np.array([pixel]))[0] - goal)))
            out[name] = (1, e, e)
        return out


def fit_floors(points: DataFrame, keys: list[str], centre: tuple[float, float], r0: float) -> DataFrame:
    """keys..., line, pixels, rms_m, max_m, k: a floor fitted for each key (a court: some thousand traced pixels) to its lines.
    points: keys..., line, axis (x or y, constant along the line), value, px, py."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        lines = {n: (g[["px", "py"]].to_numpy(float), g["axis"].iloc[0], float(g["value"].iloc[0])) for n, g in pdf.groupby("line", sort=True)}
        fit = FloorFit(lines, {}, centre, r0)
        first = [pdf[k].iloc[0] for k in keys]
        return pd.DataFrame([[*first, n, *q, fit.k] for n, q in fit.quality().items()], columns=[*keys, "line", "pixels", "rms_m", "max_m", "k"])

    clean = points.filter("px IS NOT NULL AND py IS NOT NULL").select(*keys, "line", "axis", "value", "px", "py")
    return clean.groupBy(*keys).applyInPandas(fn, f"{ddl}, line string, pixels bigint, rms_m double, max_m double, k double")


def in_polygon(x: str, y: str, corners: list[tuple[float, float]]):
    """Point in polygon by ray casting, as a Column: how often a ray to the right crosses an edge, odd or even."""
    px, py = F.col(x), F.col(y)
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1]):
        if y0 == y1:
            continue
        spans = (F.lit(y0) > py) != (F.lit(y1) > py)
        crossings = crossings + F.when(spans & (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0), 1).otherwise(0)
    return crossings % 2 == 1
