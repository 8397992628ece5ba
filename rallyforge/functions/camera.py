"""Pixels to court and back: a homography with an optional division model of the lens, as Column arithmetic."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lens:
    """Division model: an undistorted point lies at c + (p - c) / (1 + k r^2), with r in units of r0."""

    k: float
    cx: float
    cy: float
    r0: float


@dataclass(frozen=True)
class Calibration:
    h: tuple[tuple[float, float, float], ...]
    lens: Lens | None = None


def undistort(px: Column, py: Column, lens: Lens) -> tuple[Column, Column]:
    vx, vy = px - lens.cx, py - lens.cy
    scale = 1 + lens.k * ((vx * vx + vy * vy) / (lens.r0 * lens.r0))
    return lens.cx + vx / scale, lens.cy + vy / scale


def distort(ux: Column, uy: Column, lens: Lens) -> tuple[Column, Column]:
    """Inverse of undistort. The direction from the centre stays; its length p solves p = u (1 + k p^2), the smaller root of a
    quadratic. NULL where there is none (k > 0, far out)."""
    vx, vy = ux - lens.cx, uy - lens.cy
    inside = 1 - 4 * lens.k * ((vx * vx + vy * vy) / (lens.r0 * lens.r0))
    ratio = 2 / (1 + F.sqrt(F.when(inside >= 0, inside)))
    return lens.cx + vx * ratio, lens.cy + vy * ratio


def project(h, x: Column, y: Column) -> tuple[Column, Column]:
    """A plane to a plane by a 3 x 3 matrix; NULL at infinity."""
    w = float(h[2][0]) * x + float(h[2][1]) * y + float(h[2][2])
    w = F.when(w != 0, w)
    return (float(h[0][0]) * x + float(h[0][1]) * y + float(h[0][2])) / w, (float(h[1][0]) * x + float(h[1][1]) * y + float(h[1][2])) / w


def to_court(cal: Calibration, px: Column, py: Column) -> tuple[Column, Column]:
    return project(cal.h, *(undistort(px, py, cal.lens) if cal.lens else (px, py)))


def to_pixels(cal: Calibration, x: Column, y: Column) -> tuple[Column, Column]:
    ux, uy = project(np.linalg.inv(np.array(cal.h, float)), x, y)
    return distort(ux, uy, cal.lens) if cal.lens else (ux, uy)


def foot_point(image_height: float, horizon: float = 385.0, camera: float = 0.6, ankle: float = 0.08, sure: float = 0.5) -> dict[str, Column]:
    """Where a detection stands, in pixels, from its box (x0, x1, y1) and ankles (lank_, rank_ x, y, c).

    Across, the mean of the sure ankles, else the middle of the box; down, the bottom of the box, unless it is cut off by
    the picture's edge: then the ankles' row, carried down to the floor by the heights of camera and ankle."""
    left, right = F.coalesce(F.col("lank_c") > sure, F.lit(False)), F.coalesce(F.col("rank_c") > sure, F.lit(False))
    pick = lambda a, b, none: F.when(left & right, (a + b) / 2).when(left, a).when(right, b).otherwise(none)
    fx = pick(F.col("lank_x"), F.col("rank_x"), (F.col("x0") + F.col("x1")) / 2)
    row = pick(F.col("lank_y"), F.col("rank_y"), F.col("y1"))
    cut = F.col("y1") >= image_height - 3
    fy = F.when(cut, row + (row - horizon) * ankle / (camera - ankle)).otherwise(F.col("y1"))
    return {"fx": fx, "fy": fy, "ankle_vis": left | right, "feet_cut": cut}
