"""Structured Streaming forms of what can be told while a game goes on."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


READING = ["game_id", "clip", "player", "frame"]


def versions(positions: DataFrame, late: str = "2 days") -> DataFrame:
    """Readings as they come, each version of a key once within the watermark: copies are dropped, corrections come through
    however they are ordered. What counts is the version that was ingested last (newest_of, or an upsert by it)."""
    return positions.withWatermark("ingested_at", late).dropDuplicatesWithinWatermark([*READING, "ingested_at"])


def newest_of(written: DataFrame) -> DataFrame:
    """Of the versions that a stream has written, the newest of each key; one whose time of ingestion is not known is older
    than any other."""
    rest = [c for c in written.columns if c not in READING]
    newest = F.max_by(F.struct(*rest), F.struct("ingested_at"))  # a struct: max_by leaves out rows that it cannot order
    return written.groupBy(*READING).agg(newest.alias("__v")).select(*READING, "__v.*")


def activity(readings: DataFrame, late: str = "10 seconds", width: str = "1 second", slide: str = "500 milliseconds") -> DataFrame:
    """Mean speed of each clip in sliding windows of event time `ts`; late rows beyond the watermark are dropped."""
    window = F.window("ts", width, slide)
    return readings.withWatermark("ts", late).groupBy("game_id", "clip", window).agg(F.avg("speed").alias("activity"), F.count("*").alias("n"))


def serve_sessions(events: DataFrame, gap_s: float = 3.0, late: str = "30 seconds") -> DataFrame:
    """Serve clusters as session windows: an event (ts, duration) keeps its session open for its duration and the gap."""
    gap = F.format_string("%d milliseconds", F.round((F.col("duration") + gap_s) * 1000).cast("bigint"))
    opened = events.withWatermark("ts", late)
    return opened.groupBy("game_id", "clip", F.session_window("ts", gap)).agg(F.count("*").alias("events"), F.sum("duration").alias("duration"), F.min_by("server", "ts").alias("server"))


SCORE = "game_id string, clip int, rally int, winner string, score_p1 int, score_p2 int, final boolean"


def decided(rally: tuple, next_: tuple) -> str | None:
    """Winner of a rally (number, server, box): who serves the next one, unless that is the same serve once more."""
    server, then = rally[1], next_[1]
    return then if server and then and (then, next_[2]) != (server, rally[2]) else None


def running_score(rallies: DataFrame, late: str = "10 minutes", idle_s: int = 3600, game_ball: int = 15) -> DataFrame:
    """The score after each rally (game_id, clip, rally, server, box, event time ts), from state per clip. A rally's winner is
    known when the next one has come; rallies that come early wait in the state for those before them, copies count once.
    When nothing has come for idle_s of event time beyond the watermark, the clip is over: what still waits is decided in
    order, whatever is missing between, the last rally by game ball (final = true), and the state goes. Without a column ts
    there is no time to go by: nothing ends, and the last rally stays open."""
    timed = "ts" in rallies.columns

    def rows_of(key: tuple, made: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *m) for m in made], columns=[c.split()[0] for c in SCORE.split(", ")])

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        p1, p2, upto, waiting, latest = state.get if state.exists else (0, 0, None, "[]", 0)
        waits = {r[0]: tuple(r) for r in json.loads(waiting)}
        made = []
        if state.hasTimedOut:
            order = [waits[k] for k in sorted(waits)]
            for i, r in enumerate(order):
                last = i + 1 == len(order)
                edge = game_ball - 1
                winner = decided(r, order[i + 1]) if not last else ("p1" if p1 == edge > p2 else "p2" if p2 == edge > p1 else None) if r[1] else None
                p1, p2 = p1 + (winner == "p1"), p2 + (winner == "p2")
                made.append((r[0], winner, p1, p2, last))
            state.remove()
            yield rows_of(key, made)
            return
        for batch in batches:
            for r in batch.itertuples():
                if upto is None or r.rally > upto:
                    waits.setdefault(int(r.rally), (int(r.rally), r.server or None, r.box or None))
                latest = max(latest, int(r.ts.timestamp() * 1000)) if timed else latest
        first = min(waits, default=None) if upto is None else upto + 1
        while first in waits and first + 1 in waits:
            winner = decided(waits.pop(first), waits[first + 1])
            p1, p2 = p1 + (winner == "p1"), p2 + (winner == "p2")
            made.append((first, winner, p1, p2, False))
            upto, first = first, first + 1
        state.update((p1, p2, upto, json.dumps(sorted(waits.values())), latest))
        if timed:
            state.setTimeoutTimestamp(max(latest + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield rows_of(key, made)

    rows = rallies.withWatermark("ts", late) if timed else rallies
    return rows.groupBy("game_id", "clip").applyInPandasWithState(
        update, SCORE, "p1 int, p2 int, upto int, waiting string, latest bigint", "append", GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    )
