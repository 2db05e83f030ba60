"""Onsets of sound that arrives in chunks, and ball tracklets of frames that arrive one by one; both as their batch versions, whatever a trigger brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rallyplan.operators.onsets import Picker
from rallyplan.operators.tracking import BallLinker

ONSETS = "video_id long, frame long, strength double, threshold double"
TRACKLETS = "video_id long, tracklet long, frame long, x double, y double, strength double"


def onset_stream(chunks: DataFrame, hop: int) -> DataFrame:
    """Onsets of chunks (video_id, start, samples, last); a video's chunks come in order from trigger to trigger, the last one says so.

    The state is a frame's sums and some twenty strengths a video; it goes with the last chunk.
    """

    def pick(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        picker, out, over = Picker.restored(state.get[0]) if state.exists else Picker(hop), [], False
        for row in pd.concat(list(batches)).sort_values("start", kind="stable").itertuples():
            out += picker.feed(int(row.start), list(row.samples))
            if row.last:
                out, over = out + list(picker.close()), True
        if over:
            state.remove()
        else:
            state.update((picker.saved(),))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["video_id", "frame", "strength", "threshold"])

    return _stateful(chunks, pick, ONSETS)


def ball_stream(candidates: DataFrame, patience: int) -> DataFrame:
    """Tracklets (a row for each of their places) out of frames (video_id, frame, last, candidates: array of x, y, score, on_person).

    Frames of a video come in order from trigger to trigger. A tracklet comes out when it
    was missed more than ``patience`` times in a row, or with the last frame. The state
    holds the open tracklets.
    """

    def link(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        linker, done, over = BallLinker.restored(state.get[0]) if state.exists else BallLinker(patience), [], False
        for row in pd.concat(list(batches)).sort_values("frame", kind="stable").itertuples():
            done += linker.frame(int(row.frame), [(c["x"], c["y"], c["score"], c["on_person"]) for c in row.candidates])
            if row.last:
                done, over = done + linker.close(), True
        if over:
            state.remove()
        else:
            state.update((linker.saved(),))
        rows = [(key[0], k.id, f, x, y, k.strength) for k in done if k.usable for f, (x, y) in zip(k.frames, k.xy, strict=True)]
        yield pd.DataFrame(rows, columns=["video_id", "tracklet", "frame", "x", "y", "strength"])

    return _stateful(candidates, link, TRACKLETS)


def _stateful(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    return rows.groupBy("video_id").applyInPandasWithState(f, schema, "saved string", "append", GroupStateTimeout.NoTimeout)
