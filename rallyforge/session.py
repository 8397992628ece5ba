"""Session helpers: where lineage is cut, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest lookup table that is broadcast, in rows of two or three narrow columns.
BROADCAST_ROWS = 500_000
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: what the cluster names, else a folder of this machine (tests only). Checkpoints
    that nothing refers to any more are deleted, and what is left of them when the driver ends."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        settings = sc._jsc.sc().conf()
        if not settings.contains(CLEAN):
            settings.set(CLEAN, "true")
        folder = _named_checkpoint_dir(spark)
        delete_at_end(spark, sc.getCheckpointDir() or folder)
        return folder
    return _named_checkpoint_dir(spark)


def delete_at_end(spark: SparkSession, folder: str) -> None:
    """A folder of this session's own goes when the driver ends."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def own_folder(spark: SparkSession, kind: str) -> str:
    """A new folder beside the checkpoints, deleted when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return folder


def _named_checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rallyforge-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder; later jobs read it from there, whatever executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as a table beside the checkpoints and read from there: smaller than a checkpoint, and read by columns."""
    folder = own_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup table; it is broadcast only when its counted rows stay within the bound, else joined by shuffle
    (with adaptive skew splitting)."""
    return df.join(sized(small, most), on, how)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its counted rows stay within the bound; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def importable_by_workers(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it (on clusters, also ship it with --py-files)."""
    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
