"""Appearance vectors: pairs of detections in a frame, the axis that separates them, and two means along it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyforge.session import cut_lineage, lookup


def unit(v: str) -> Column:
    """The vector over its length; a zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def frame_pairs(rows: DataFrame, keys: list[str], id_: str, vector: str) -> DataFrame:
    """keys..., a, b, va, vb for the groups with exactly two rows, both with a vector; a is the smaller id. Built from one
    aggregation (a group's first and last row), not from a self-join."""
    item = F.struct(id_, vector)
    two = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(vector).alias("m"), F.min_by(item, id_).alias("x"), F.max_by(item, id_).alias("y")).filter("n = 2 AND m = 2")
    return two.select(*keys, F.col(f"x.{id_}").alias("a"), F.col(f"y.{id_}").alias("b"), F.col(f"x.{vector}").alias("va"), F.col(f"y.{vector}").alias("vb"))


def gram(pairs: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of the differences va - vb: size x size numbers, whatever the number of pairs. Each task
    adds up its own matrix; only these reach the driver."""

    def add(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            d = batch.column("d").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            total += d.T @ d
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(flat)], names=["i", "v"])

    d = pairs.select(F.zip_with("va", "vb", lambda x, y: x.cast("double") - y.cast("double")).alias("d")).filter(F.size("d") == size)
    cells = d.mapInArrow(add, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # size * size rows
    out = np.zeros(size * size)
    for r in cells:
        out[r["i"]] = r["v"]
    return out.reshape(size, size)


def separating_axis(pairs: DataFrame, size: int) -> np.ndarray:
    """First right singular vector of the pairs' differences (sign: its largest entry is positive)."""
    axis = np.linalg.eigh(gram(pairs, size))[1][:, -1]
    return axis * np.sign(axis[np.argmax(np.abs(axis))] or 1.0)


def two_means(rows: DataFrame, value: str, rounds: int = 20) -> tuple[float, float]:
    """Two centres in one dimension, from the quartiles (to a ten-thousandth of the rows, which is enough to start from and holds
    a bounded summary); each round is one aggregation. Stops when they settle."""
    c0, c1 = rows.agg(F.percentile_approx(value, [0.25, 0.75], 10_000).alias("q")).first()["q"] or (0.0, 0.0)
    for _ in range(rounds):
        low = F.abs(F.col(value) - c0) <= F.abs(F.col(value) - c1)
        r = rows.agg(F.avg(F.when(low, F.col(value))).alias("a"), F.avg(F.when(~low, F.col(value))).alias("b")).first()
        new = (r["a"] if r["a"] is not None else c0, r["b"] if r["b"] is not None else c1)
        if new == (c0, c1):
            break
        c0, c1 = new
    return c0, c1


def axis_scores(rows: DataFrame, vector: str, axis: np.ndarray, rounds: int = 20) -> DataFrame:
    """Adds score: place along the axis, scaled so that the two means lie at -1 and 1."""
    placed = cut_lineage(rows.withColumn("__p", dot(vector, F.array(*(F.lit(float(x)) for x in axis)))))
    c0, c1 = two_means(placed, "__p", rounds)
    width = (c1 - c0) or 1.0
    return placed.withColumn("score", (F.col("__p") - (c0 + c1) / 2) / width * 2).drop("__p")


def pair_quality(scored: DataFrame, keys: list[str], id_: str = "vec_id", by: tuple[str, ...] = ()) -> DataFrame:
    """How well the score tells the two of a frame (keys) apart, for each `by`: pairs, quantiles of the gap, share with opposite
    signs."""
    two = scored.groupBy(*{k: None for k in (*by, *keys)}).agg(F.count("*").alias("n"), F.min_by("score", id_).alias("a"), F.max_by("score", id_).alias("b")).filter("n = 2")
    return two.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.percentile(F.abs(F.col("a") - F.col("b")), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("gaps"),
        F.avg((F.signum("a") * F.signum("b") < 0).cast("int")).alias("opposite_share"),
    )


def z_scores(rows: DataFrame, columns: list[str], fill: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Each column less its mean over its deviation (of the sample, + 1e-9), over all rows or those of each `by`; those in fill
    first take their median where they are missing. Two aggregations, of a row for each `by`, made once and joined behind a
    counted bound."""

    def joined(rows: DataFrame, stats: DataFrame) -> DataFrame:
        return lookup(rows, cut_lineage(stats), list(by)) if by else rows.join(F.broadcast(stats))  # without by: one row

    if fill:
        medians = rows.groupBy(*by).agg(*(F.median(c).alias("__m_" + c) for c in fill))
        rows = joined(rows, medians).select(*(F.coalesce(c, "__m_" + c).alias(c) if c in fill else F.col(c) for c in rows.columns))
    stats = rows.groupBy(*by).agg(*(F.avg(c).alias("__a_" + c) for c in columns), *(F.stddev_samp(c).alias("__s_" + c) for c in columns))
    return joined(rows, stats).select(
        *(((F.col(c) - F.col("__a_" + c)) / (F.col("__s_" + c) + 1e-9)).alias(c) if c in columns else F.col(c) for c in rows.columns)
    )


#: What the identity model looks at, beside the descriptor d0 ... and the embedding c0 ...
HAND = ["chest_s", "chest_v", "th_h", "th_s", "th_v", "shirt_v", "shorts_s", "shorts_v"]


def feature_table(detections: DataFrame, patches: DataFrame, appearance: DataFrame, cnn: DataFrame, key: list[str], n_d: int = 28, n_c: int = 512) -> tuple[DataFrame, list[str], list[str]]:
    """detections with all their features, as columns: those by hand (of which the missing ones can be filled), and those of the
    embedding. All joins are by the detection's key and keep every detection; the four tables are partitioned alike, once each."""
    wide = detections.join(patches, key, "left").join(appearance, key, "left").join(cnn, key, "left")
    for c in "hsv":
        wide = wide.withColumn(f"th_{c}", mean_known(f"lth_{c}", f"rth_{c}"))
    by_hand, learned = HAND + [f"d{i}" for i in range(n_d)], [f"c{i}" for i in range(n_c)]
    made = wide.select(
        *detections.columns, *HAND, *(F.get("d", F.lit(i)).cast("double").alias(f"d{i}") for i in range(n_d)), *(F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(n_c))
    )
    return made, by_hand, learned


def with_labels(features: DataFrame, tracklets: DataFrame, classes: DataFrame, key: list[str], of_tracklet: list[str]) -> DataFrame:
    """Adds tracklet and class (-1: not labelled)."""
    rows = features.join(lookup(tracklets, classes, of_tracklet).select(*key, "tracklet", "class"), key, "left")
    return rows.withColumn("class", F.coalesce("class", F.lit(-1)))


def patch_anchors() -> dict[str, Column]:
    """Centres of the chest and thigh patches from keypoints: 0.6 shoulder + 0.4 hip, 0.6 hip + 0.4 knee."""
    mix = lambda a, b: 0.6 * F.col(a) + 0.4 * F.col(b)
    out = {}
    for axis in "xy":
        out[f"chest_{axis}"] = (mix(f"lsho_{axis}", f"lhip_{axis}") + mix(f"rsho_{axis}", f"rhip_{axis}")) / 2
        for side in "lr":
            out[f"{side}th_{axis}"] = mix(f"{side}hip_{axis}", f"{side}kne_{axis}")
    return out


def mean_known(a: str, b: str) -> Column:
    """Mean of those that are there."""
    return F.coalesce((F.col(a) + F.col(b)) / 2, a, b)


# ---- colours of a picture (rows x columns x HSV, hue to 180), for use in a pandas UDF or mapInPandas

#: Confidence from which a joint counts; where none does, bands of the box stand in for it.
JOINT_SURE = 0.3
H_BINS, SV_BINS = 12, 8


def cut_out(picture: np.ndarray, x: tuple[float, float], y: tuple[float, float], least: tuple[int, int]) -> np.ndarray | None:
    """The part of a picture between two columns and two rows, None if less than (columns, rows) of it are inside."""
    (xa, xb), (ya, yb) = ((int(max(0, a)), int(min(size, b))) for (a, b), size in ((x, picture.shape[1]), (y, picture.shape[0])))
    return picture[ya:yb, xa:xb] if xb - xa >= least[0] and yb - ya >= least[1] else None


def medians(part: np.ndarray | None) -> list[float]:
    return [float("nan")] * 3 if part is None else np.median(part.reshape(-1, 3).astype(float), axis=0).tolist()


def patch_colour(picture: np.ndarray, cx: float, cy: float, radius: float) -> list[float]:
    """Median hue, saturation and value of a square around a place; NaN where there are not two pixels each way."""
    return medians(cut_out(picture, (cx - radius, cx + radius + 1), (cy - radius, cy + radius + 1), (2, 2)))


def sure_mean(joints: np.ndarray, axis: int, otherwise: float) -> float:
    """Mean coordinate of the joints (x, y, confidence) that count."""
    sure = joints[:, 2] > JOINT_SURE
    return float(joints[sure, axis].mean()) if sure.any() else otherwise


def shorts_colour(picture: np.ndarray, box: tuple[float, float, float, float], hips: np.ndarray, knees: np.ndarray) -> list[float]:
    """Median colour between hips and knees; without both hips and a knee, of the middle of the box's 45th to 68th percent."""
    x0, y0, x1, y1 = box
    if (hips[:, 2] > JOINT_SURE).all() and (knees[:, 2] > JOINT_SURE).any():
        middle, half = hips[:, 0].mean(), max(8.0, 0.9 * abs(hips[0, 0] - hips[1, 0]))
        x, y = (middle - half, middle + half), (hips[:, 1].mean(), sure_mean(knees, 1, y1))
    else:
        x, y = (x0 + 0.2 * (x1 - x0), x1 - 0.2 * (x1 - x0)), (y0 + 0.45 * (y1 - y0), y0 + 0.68 * (y1 - y0))
    return medians(cut_out(picture, x, y, (3, 3)))


def descriptor(picture: np.ndarray, box: tuple[float, float, float, float], shoulders: np.ndarray, hips: np.ndarray, knees: np.ndarray) -> list[float] | None:
    """31 numbers of a body: hue histogram weighted by saturation, saturation and value histograms, each as shares; then the
    mean value above the hips, mean saturation and value below. None for fewer than 3 x 6 pixels."""
    x0, y0, x1, y1 = box
    top, bottom = sure_mean(shoulders, 1, y0 + 0.2 * (y1 - y0)), sure_mean(knees, 1, y0 + 0.7 * (y1 - y0))
    body = cut_out(picture, ((x0 + x1) / 2 - 0.3 * (x1 - x0), (x0 + x1) / 2 + 0.3 * (x1 - x0)), (top, bottom), (3, 6))
    if body is None:
        return None
    waist = int(np.clip(sure_mean(hips, 1, (top + bottom) / 2) - int(max(0, top)), 1, len(body) - 1))
    upper, lower = body[:waist].astype(float), body[waist:].astype(float)
    return [*hsv_histograms(body), upper[..., 2].mean(), lower[..., 1].mean(), lower[..., 2].mean()]


def hsv_histograms(part: np.ndarray) -> np.ndarray:
    h, s, v = (part[..., i].ravel().astype(float) for i in range(3))
    hue = np.histogram(h, H_BINS, (0, 180), weights=s / 255)[0]
    return np.concatenate([hue / max(hue.sum(), 1e-6), *(np.histogram(c, SV_BINS, (0, 256))[0] / len(c) for c in (s, v))])


def hsv_descriptor(pixels: np.ndarray) -> np.ndarray | None:
    """The histograms alone, of a crop as it is; None for crops under 3 x 6 pixels."""
    return None if pixels.shape[0] < 6 or pixels.shape[1] < 3 else hsv_histograms(pixels)


def patch_colours(rows: DataFrame, keep: list[str], places: dict[str, tuple[str, str]], radius: str = "radius") -> DataFrame:
    """keep..., and name_h, name_s, name_v around each named place (columns of x and y; NULL: no place) in the picture of each row:
    pixels (HSV bytes, row by row), height, width."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields)
    names = [f"{n}_{c}" for n in places for c in "hsv"]

    def run(batches):
        import pandas as pd

        for part in batches:
            made = []
            for r in part.itertuples():
                picture = np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), 3)
                at = ((getattr(r, x), getattr(r, y)) for x, y in places.values())
                made.append([v for x, y in at for v in (patch_colour(picture, x, y, getattr(r, radius)) if x == x and y == y and x is not None and y is not None else [None] * 3)])
            yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(made, columns=names, dtype=float)], axis=1)

    out = rows.mapInPandas(run, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
    return out.select(*keep, *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))
