"""Court geometry as Column expressions. Fixed values of the court, in metres. NULL in, NULL out, everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, LENGTH, SHORT_LINE, BOX = 6.40, 9.75, 5.44, 1.60
T_X, T_Y = 3.2, 5.44
TIN, SERVICE, OUT = 0.43, 1.78, 4.57
FRONT_END, BACK_START = 3.0, 6.24
BOXES = {"left": (0.0, SHORT_LINE, BOX, SHORT_LINE + BOX), "right": (WIDTH - BOX, SHORT_LINE, WIDTH, SHORT_LINE + BOX)}
ZONES = ("front-left", "front-right", "mid-left", "mid-right", "back-left", "back-right")


def zone_row(y: Column) -> Column:
    """0 front, 1 middle, 2 back; a line belongs to the zone behind it."""
    return F.when(y < FRONT_END, 0).when(y < BACK_START, 1).when(y.isNotNull(), 2)


def zone_col(x: Column) -> Column:
    """0 left, 1 right; the middle line is right."""
    return (x >= T_X).cast("int")


def zone_name(x: Column, y: Column) -> Column:
    return F.get(F.array(*map(F.lit, ZONES)), 2 * zone_row(y) + zone_col(x))


def dist_to_t(x: Column, y: Column) -> Column:
    return F.hypot(x - T_X, y - T_Y)


def in_box(x: Column, y: Column, box: str, pad: float = 0.0) -> Column:
    x0, y0, x1, y1 = BOXES[box]
    return x.between(x0 - pad, x1 + pad) & y.between(y0 - pad, y1 + pad)


def box_of(x: Column, y: Column, pad: float = 0.35) -> Column:
    """left, right or NULL; left wins where padded boxes meet."""
    return F.when(in_box(x, y, "left", pad), "left").when(in_box(x, y, "right", pad), "right")


def receiver_ok(x: Column, y: Column, box: Column, rule: str = "opposite_half") -> Column:
    """Stands the receiver where a serve from box is awaited? Rule: opposite_half or past_inner_line."""
    left, right = (WIDTH / 2 + 0.3, WIDTH / 2 - 0.3) if rule == "opposite_half" else (BOX + 0.3, WIDTH - BOX - 0.3)
    side = F.when(box == "left", x > left).when(box == "right", x < right)
    return F.coalesce(side & (y > SHORT_LINE - 1.5), F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """greatest and least skip NULL, so NULL must be kept out of them."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def court_lines(spark: SparkSession) -> DataFrame:
    """The painted lines: name, x0, y0, x1, y1."""
    lines = [
        ("front wall", 0.0, 0.0, WIDTH, 0.0), ("back wall", 0.0, LENGTH, WIDTH, LENGTH), ("left wall", 0.0, 0.0, 0.0, LENGTH),
        ("right wall", WIDTH, 0.0, WIDTH, LENGTH), ("short line", 0.0, SHORT_LINE, WIDTH, SHORT_LINE), ("half line", T_X, SHORT_LINE, T_X, LENGTH),
    ]
    for name, (x0, y0, x1, y1) in BOXES.items():
        lines += [(f"{name} box", x0, y0, x1, y0), (f"{name} box", x0, y1, x1, y1), (f"{name} box", x0, y0, x0, y1), (f"{name} box", x1, y0, x1, y1)]
    lines = [(name, *(round(v, 2) for v in ends)) for name, *ends in lines]
    return spark.createDataFrame(lines, "name string, x0 double, y0 double, x1 double, y1 double")
