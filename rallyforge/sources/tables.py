"""Table scans with explicit contracts, and the cleaning that every consumer shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def present(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column: Spark orders NaN above all numbers, so it must not reach predicates."""
    return df.select(
        *(
            F.when(~F.isnan(f.name), F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def of_sources(positions: DataFrame) -> DataFrame:
    """Rows that belong to a source: a player is named and the frame is known."""
    return positions.filter((F.col("player") != "") & F.col("frame").isNotNull())


def game_strides(games: DataFrame) -> DataFrame:
    return games.filter(F.col("game_id").isNotNull()).groupBy("game_id").agg(F.max("frame_stride").cast("int").alias("stride"))


#: Frames of a clip are cut into chunks of so many where a partition needs a bound.
CHUNK_FRAMES = 32_768


def clean_positions(positions: DataFrame) -> DataFrame:
    """Counted rows of sources: the newest version of each key, numbers finite or NULL.

    One shuffle by source and chunk of frames; the newest version is the first of its frame in that order."""
    key = ["game_id", "clip", "player", F.floor(F.col("frame") / CHUNK_FRAMES)]
    order = Window.partitionBy(*key).orderBy("frame", F.col("ingested_at").desc_nulls_last())
    rows = of_sources(positions).withColumn("__before", F.lag("frame").over(order)).filter("__before IS NULL OR __before <> frame")
    finite = lambda f: F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name)
    return rows.select(*(finite(f) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in positions.schema.fields if f.name != "ingested_at"))


def clean_rallies(rallies: DataFrame) -> DataFrame:
    """Rallies without copies, NaN as NULL."""
    return nan_to_null(rallies).dropDuplicates(["game_id", "clip", "rally"])
