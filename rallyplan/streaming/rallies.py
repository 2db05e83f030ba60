"""Streams of hits: serving slices, rallies by a fixed gap, and rallies by the full rule with state.

Batch is the authority: the tests hold the streams against it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rallyplan.schema import LIMITS

RALLY = "session_id long, rally long, start_s double, end_s double, shot_count long"
STATE = "rally long, start_s double, last_t double, last_side int, n long"


def slices(hits: DataFrame, late: str = "1 minute") -> DataFrame:
    """Hits by tumbling windows of 10 s, for serving; rows later than ``late`` are dropped."""
    w = hits.withWatermark("at", late).groupBy("session_id", F.window("at", "10 seconds"))
    return w.agg(F.count("*").alias("n"), F.max("hit_score").alias("best")).select("session_id", F.col("window.start").alias("start"), "n", "best")


def fixed_gap_rallies(hits: DataFrame, late: str = "1 minute") -> DataFrame:
    """Rallies as session windows of 3 s; a gap of exactly 3 s doesn't end one."""
    w = hits.withWatermark("at", late).groupBy("session_id", F.session_window("at", f"{LIMITS.rally_gap_s + 0.000001:.6f} seconds"))
    return w.agg(F.count("*").alias("shot_count"), F.min("t").alias("start_s"), F.max("t").alias("end_s")).select("session_id", "start_s", "end_s", "shot_count")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rallies that end with these rows; the open one stays in the state until the next one starts, or the watermark is past any hit that could go on with it."""
    rally, start, last, side, n = state.get if state.exists else (-1, 0.0, float("-inf"), 0, 0)
    ended = []
    if state.hasTimedOut:
        if n:
            ended.append((key[0], rally, start, last, n))
        state.update((rally, start, last, side, 0))
    else:
        rows = pd.concat(list(batches)).sort_values(["t", "shot_id"], kind="stable")
        for t, s, serve in zip(rows.t, rows.side, rows.stroke == "serve", strict=True):
            gap = t - last
            goes_on = gap <= LIMITS.rally_gap_s or (gap <= LIMITS.missed_hit_gap_s and s == side)
            if serve or not goes_on:
                if n:
                    ended.append((key[0], rally, start, last, n))
                rally, start, n = rally + 1, t, 0
            last, side, n = float(t), int(s), n + 1
        state.update((int(rally), float(start), last, side, int(n)))
        over = int(rows["at"].max().timestamp() * 1000) + int(LIMITS.missed_hit_gap_s * 1000) + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(ended, columns=[c.split()[0] for c in RALLY.split(", ")])


def stateful_rallies(hits: DataFrame, late: str = "1 minute") -> DataFrame:
    """Rallies by the full rule (a longer gap is allowed if the same side hits again, a serve starts one).

    Rows of a session have to come in order of time from trigger to trigger, as from
    one camera; the state is five numbers a session.
    """
    return hits.withWatermark("at", late).groupBy("session_id").applyInPandasWithState(_advance, RALLY, STATE, "append", GroupStateTimeout.EventTimeTimeout)
