"""The serve chain over recorded positions, and over positions made from events, which hold many more serves."""

import duckdb
import pytest
from test_contract import rows

import __spark_entry__ as entry
from rallyforge.operators import serves, signals
from rallyforge.plans.derived import positions_of_events
from rallyforge.plans.sql import ACTIVE, CLUSTERS, EVENTS, POS, SERVE_OF_EVENTS, pace, q, rates, wide

RECORDED = "/root/testdata/sf0.01"
FOUND = {
    "serve_events": ((), "SELECT game_id, clip, server, box, t0, t1 FROM events_found"),
    "serve_clusters": ((CLUSTERS,), "SELECT game_id, clip, t0, t1, server, box FROM clusters"),
}


def result(data, sql):
    con = duckdb.connect()
    for name in ("positions", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con.sql(sql).df()


@pytest.mark.parametrize("name", FOUND)
def test_recorded_positions(spark, name):
    more, select = FOUND[name]
    want = result(RECORDED, q(POS, wide(), rates(), ACTIVE, pace(), EVENTS, *more, select=select))
    assert len(want) and rows(entry.queries()[name](spark, RECORDED).toPandas()) == rows(want)


@pytest.mark.parametrize("name", ["detected_rallies", "segment_rallies", "dropped_segments", "infer_missed_serves", "ambiguous_clusters"])
def test_only_recorded_games(spark, name):
    games = {r[0] for r in spark.read.parquet(f"{RECORDED}/games.parquet").select("game_id").collect()}
    found = {r[0] for r in entry.queries()[name](spark, RECORDED).select("game_id").distinct().collect()}
    assert found <= games and (found or name == "dropped_segments")


def test_positions_made_from_events(spark):
    data = "/root/testdata/sf0.001"
    pos = positions_of_events(spark.read.parquet(f"{data}/events.parquet"))
    active = signals.activity(signals.side_by_side(pos), signals.sample_rate(pos))
    events = serves.serve_events(active, signals.pace_parameters(active, pos))
    assert rows(events.toPandas()) == rows(result(data, q(*SERVE_OF_EVENTS, select=FOUND["serve_events"][1])))
    assert rows(serves.serve_clusters(events).drop("ambiguous").toPandas()) == rows(result(data, q(*SERVE_OF_EVENTS, CLUSTERS, select=FOUND["serve_clusters"][1])))
