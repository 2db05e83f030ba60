"""People tracked online: the tracker's state stays with Spark between triggers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rallyplan.operators.tracking import PeopleTracker, _Seen

TRACKED = "video_id long, frame_idx long, detection long, track long"


def _saved(tracker: PeopleTracker) -> str:
    return json.dumps([tracker.used, [[k.id, k.t, k.foot.tolist(), k.box.tolist(), k.look.tolist(), k.pace.tolist()] for k in tracker.live]])


def _restored(text: str) -> PeopleTracker:
    used, live = json.loads(text)
    return PeopleTracker(live=[_Seen(i, t, *map(np.array, rest)) for i, t, *rest in live], used=used)


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tracker = _restored(state.get[0]) if state.exists else PeopleTracker()
    rows = pd.concat(list(batches)).sort_values(["frame_idx", "detection"], kind="stable")
    out = []
    for frame, r in rows.groupby("frame_idx", sort=True):
        people = [(np.array(f, float), np.array(b, float), np.array(a, float)) for f, b, a in zip(r.foot, r.box, r["look"], strict=True)]
        out += [(key[0], frame, d, i) for d, i in zip(r.detection, tracker.frame(float(r.t.iloc[0]), people), strict=True)]
    state.update((_saved(tracker),))
    yield pd.DataFrame(out, columns=["video_id", "frame_idx", "detection", "track"])


def tracked(detections: DataFrame) -> DataFrame:
    """Track ids of detections (video_id, frame_idx, detection, t, foot, box, look); frames of a video come in order from trigger to trigger.

    The state holds people seen within the last second of a video, a handful.
    """
    return detections.groupBy("video_id").applyInPandasWithState(_track, TRACKED, "tracker string", "append", GroupStateTimeout.NoTimeout)
