"""Files in and out: parquet, CSV with rounding at the boundary, JSON, configuration, arrays and pictures."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from rallyforge.session import lookup
from rallyforge.sources.tables import nan_to_null


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """With a header and an explicit schema; empty fields are NULL."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", nanValue="NaN")


def write_csv(df: DataFrame, path: str, digits: int = 4, mode: str = "overwrite") -> None:
    """Floating columns rounded: what the next stage reads is what was written, so rounding is part of the result."""
    columns = [F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema.fields]
    df.select(*columns).write.mode(mode).csv(path, header=True)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = "game_id", mode: str = "overwrite") -> None:
    """One folder per value of `by`; rows are brought together by it first, so a value's rows are few files, and adaptive
    execution splits a large value over several."""
    if by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def stage(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """The stored result of a stage, made first if it is not there or a new one is wanted."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if force or not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pictures(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Extracted frames as path, modificationTime, length, content, for a model in mapInPandas."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_arrays(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Rows of numpy files: path, row (from 0), values. A file is read whole, where it is found."""

    def rows(parts):
        import io

        import numpy as np
        import pandas as pd

        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                made = np.load(io.BytesIO(content), allow_pickle=False)
                made = made.reshape(len(made), -1).astype(float)
                yield pd.DataFrame({"path": name, "row": range(len(made)), "values": list(made)})

    return pictures(spark, path, pattern).select("path", "content").mapInPandas(rows, "path string, row bigint, values array<double>")


def write_arrays(df: DataFrame, folder: str, key: str, values: str) -> DataFrame:
    """Array columns of one length to numpy files, two for each partition: <no>.ids.npy and <no>.values.npy, in a folder that all
    executors can write to. Lazy, as a read is: file names and rows come back, and collecting them does the writing."""

    def write(parts):
        import numpy as np
        import pandas as pd
        from pyspark import TaskContext

        kept = [p for p in parts if len(p)]
        if kept:
            no = TaskContext.get().partitionId()
            os.makedirs(folder, exist_ok=True)
            ids, rows = np.concatenate([p[key].to_numpy() for p in kept]), np.concatenate([np.stack(p[values].to_list()) for p in kept])
            for kind, data in (("ids", ids), ("values", rows)):
                unfinished = f"{folder}/.{no:05d}.{kind}.{TaskContext.get().taskAttemptId()}.npy"
                np.save(unfinished, data)
                os.replace(unfinished, f"{folder}/{no:05d}.{kind}.npy")  # a repeated task writes the same file
            yield pd.DataFrame({"file": [f"{no:05d}"], "rows": [len(ids)]})

    return df.select(key, values).mapInPandas(write, "file string, rows bigint")


def sample_frames(games: DataFrame, n: int = 60, margin_s: float = 10.0) -> DataFrame:
    """game_id, sample, t, frame: n times spread evenly over a game less a margin at both ends, for a background picture. A game
    without start begins at 0; without end or fps it has none."""
    own = nan_to_null(games.select("game_id", "fps", "t_start", "t_end")).filter("game_id IS NOT NULL AND fps IS NOT NULL AND t_end IS NOT NULL").dropDuplicates(["game_id"])
    a, b = F.coalesce("t_start", F.lit(0.0)) + margin_s, F.col("t_end") - margin_s
    rows = own.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", a + (b - a) * F.col("sample") / max(1, n - 1))
    return rows.select("game_id", "sample", "t", F.floor(F.col("t") * F.col("fps")).alias("frame"))


def sampled(frames: DataFrame, fps: float | Column, stride: int | Column, t_start: float | Column, t_end: float | Column | None) -> DataFrame:
    """Every stride-th frame of [t_start, t_end] (no end: to the last frame), with its time."""
    first, last = (F.lit(t_start) * F.lit(fps)).cast("bigint"), (F.lit(t_end) * F.lit(fps)).cast("bigint")
    first = F.coalesce(first, F.lit(0))
    inside = frames.filter((F.col("frame") >= first) & (last.isNull() | (F.col("frame") <= last)) & ((F.col("frame") - first) % F.lit(stride) == 0))
    return inside.withColumn("t", F.col("frame") / F.lit(fps))


def sampled_by_game(frames: DataFrame, games: DataFrame) -> DataFrame:
    """The frames of each game at its own fps, frame_stride, t_start and t_end. A game without stride takes 1, without start
    0, without end all frames to come; without fps t is NULL and nothing is cut off."""
    own = nan_to_null(games.select("game_id", "fps", "frame_stride", "t_start", "t_end")).filter("game_id IS NOT NULL").dropDuplicates(["game_id"])
    own = own.select("game_id", *(F.col(c).alias(f"__{c}") for c in own.columns if c != "game_id"))
    rows = lookup(frames, own, ["game_id"])
    return sampled(rows, F.col("__fps"), F.coalesce("__frame_stride", F.lit(1)), F.col("__t_start"), F.col("__t_end")).drop("__fps", "__frame_stride", "__t_start", "__t_end")


def load_config(path: str | None = None, variable: str = "RALLYFORGE_CONFIG") -> dict[str, Any]:
    """A game's YAML over its court's (key `court`: a file beside it); paths in it are relative to the file. Without a path,
    the one that the environment names."""
    import yaml

    given = path or os.environ.get(variable)
    if not given:
        raise ValueError(f"no configuration: give a path or set {variable}")
    home = Path(given).resolve().parent
    game = yaml.safe_load(Path(given).read_text()) or {}
    base: dict[str, Any] = {}
    if isinstance(game.get("court"), str) and (home / game["court"]).exists():
        base = yaml.safe_load((home / game["court"]).read_text()) or {}
    merged = base | game
    for key in ("video", "output_dir"):
        if isinstance(merged.get(key), str) and not os.path.isabs(merged[key]):
            merged[key] = str(home / merged[key])
    return merged


def summary_json(games: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., summary: one JSON document per game with the game's record and a list of its players'."""
    nested = players.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("player", *[c for c in players.columns if c not in (*keys, "player")]))).alias("players"))
    both = games.join(nested, keys, "left")
    record = F.struct(*[c for c in games.columns if c not in keys])
    return both.select(*keys, F.to_json(F.struct(record.alias("game"), "players")).alias("summary"))
