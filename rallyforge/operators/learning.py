"""Identity model: logistic regression on z-scored features, cross-validated by tracklet.

The loss is C sum(log-loss) + w^2 / 2, hence regParam = 1 / (C n) without standardisation (columns are z-scored)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyforge.session import cut_lineage, sized, stored

C, FOLDS = 0.3, 5
#: Hash parts that groups of one size are numbered in.
PARTS = 64


def to_vector(array: str):
    """ML vector of an array column, in the JVM."""
    from pyspark.ml.functions import array_to_vector

    return array_to_vector(F.transform(array, lambda x: x.cast("double")))


def fit(rows: DataFrame, features: str = "features", label: str = "label", c: float = C, rounds: int = 500, n: int | None = None) -> LogisticRegressionModel:
    """n: the number of rows, if it is known."""
    n = max(1, rows.count() if n is None else n)
    return LogisticRegression(
        featuresCol=features, labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=rounds, tol=1e-8, family="auto"
    ).fit(rows)


def group_folds(rows: DataFrame, group: list[str], folds: int = FOLDS) -> DataFrame:
    """group..., fold: groups in descending size (ties: by key), each to the fold with the fewest rows so far (ties: the first).

    Only a group's size matters for the fold that it gets, so the dealing is done for the sizes that occur: groups of one
    size are numbered by windows within hash parts, and the driver deals the counts of groups of each size - as many rows as
    there are different sizes, which is at most the root of twice the number of rows. Folds are those of dealing group by
    group, up to which of equally large groups gets which."""
    sizes = cut_lineage(rows.groupBy(*group).agg(F.count("*").alias("n")).withColumn("__p", F.pmod(F.xxhash64(*group), F.lit(PARTS))))
    per_part = sizes.groupBy("n", "__p").agg(F.count("*").alias("k"))
    before = F.sum("k").over(Window.partitionBy("n").orderBy("__p")) - F.col("k")  # at most PARTS rows of a size
    number = F.row_number().over(Window.partitionBy("n", "__p").orderBy(*group)) - 1
    placed = sizes.withColumn("__i", number).join(per_part.select("n", "__p", before.alias("__b")), ["n", "__p"]).withColumn("__i", F.col("__i") + F.col("__b"))
    counted = {r["n"]: r["k"] for r in per_part.groupBy("n").agg(F.sum("k").alias("k")).collect()}
    dealt = sized(rows.sparkSession.createDataFrame(deal(counted, folds), "n bigint, upto array<bigint>"))
    fold = F.size(F.filter("upto", lambda u: u <= F.col("__i")))
    return placed.join(dealt, "n").select(*group, fold.cast("int").alias("fold"))


def deal(counts: dict[int, int], folds: int = FOLDS) -> list[tuple[int, list[int]]]:
    """For each size, from the largest, how many of its groups the first, the first two, ... folds get, when each group goes to
    the fold with the fewest rows (ties: the first). All folds below a level fill up to it; the level is searched."""
    loads, out = [0] * folds, []
    for size in sorted(counts, reverse=True):
        below = lambda level: [max(0, -(-(level - load) // size)) for load in loads]  # noqa: B023, E731
        low, high = min(loads), max(loads) + size * counts[size] + 1
        while low < high:
            level = (low + high + 1) // 2
            low, high = (level, high) if sum(below(level)) <= counts[size] else (low, level - 1)
        got = below(low)
        for _ in range(counts[size] - sum(got)):  # fewer than there are folds
            k = min(range(folds), key=lambda k: (loads[k] + got[k] * size, k))  # noqa: B023
            got[k] += 1
        loads = [load + n * size for load, n in zip(loads, got)]
        out.append((size, [sum(got[: k + 1]) for k in range(folds)]))
    return out


def cross_validate(rows: DataFrame, group: list[str], folds: int = FOLDS, **parameters) -> DataFrame:
    """rows with fold, prediction and probabilities of the model that has not seen their group. The folds are made once and
    brought to the rows behind a counted bound, so no fit shuffles the rows; rows should be cheap to read again."""
    dealt = cut_lineage(group_folds(rows, group, folds))
    folded = rows.join(sized(dealt), group)
    counts = {r["fold"]: r["count"] for r in rows.select(*group).join(sized(dealt), group).groupBy("fold").count().collect()}  # a row for each fold
    parts = []
    for k in range(folds):
        train = folded.filter(F.col("fold") != k)
        n = sum(v for fold, v in counts.items() if fold != k)
        if not n:
            continue
        scored = fit(train, n=n, **parameters).transform(folded.filter(F.col("fold") == k))
        parts.append(scored.withColumn("probabilities", vector_to_array("probability")).drop("rawPrediction", "probability"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy(scored: DataFrame, group: list[str]) -> DataFrame:
    """rows, accuracy per row; groups, accuracy per group by majority (ties: the smaller label). The rows are scored once."""
    scored = stored(scored.select(*group, "label", "prediction"))
    per_row = scored.agg(F.count("*").alias("rows"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("row_accuracy"))
    votes = scored.groupBy(*group).agg(F.mode("prediction", deterministic=True).alias("p"), F.mode("label", deterministic=True).alias("l"))
    per_group = votes.agg(F.count("*").alias("groups"), F.avg((F.col("p") == F.col("l")).cast("int")).alias("group_accuracy"))
    return per_row.join(F.broadcast(per_group))


