import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from rallyforge.session import importable_by_workers

    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.autoBroadcastJoinThreshold", "1m").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    importable_by_workers(s)
    return s


POSITIONS = (
    "game_id string, clip int, player string, frame bigint, t double, x double, y double, speed double, dist_t double, conf double, interpolated boolean, "
    "ankle_vis boolean, feet_cut boolean, fx double, fy double, x_raw double, y_raw double, ingested_at timestamp"
)
GAMES = "game_id string, frame_stride int"


@pytest.fixture(scope="session")
def positions_of(spark):
    """Positions from dicts; what is not given is a plain reading of source g, 0, p1."""
    import datetime as dt

    def make(rows):
        base = dict(game_id="g", clip=0, player="p1", t=None, x=3.0, y=5.0, speed=1.0, dist_t=1.0, conf=0.9, interpolated=False, ankle_vis=True, feet_cut=False, fx=300.0, fy=400.0,
                    x_raw=None, y_raw=None, ingested_at=dt.datetime(2025, 1, 1))
        names = [c.split()[0] for c in POSITIONS.split(", ")]
        full = [{**base, "t": None if r.get("frame") is None else r["frame"] / 10, **r} for r in rows]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in full], POSITIONS)

    return make


@pytest.fixture(scope="session")
def games_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows) or [("g", 1)], GAMES)
