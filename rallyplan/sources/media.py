"""The seam to pose models: frames in, people out, batch by batch, with one model for each task.

Decoding and models aren't part of this package; a backend is anything that turns
a batch of frames into lists of people. What comes out follows the contract of
the people table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rallyplan.schema import KEYPOINTS


@dataclass
class Person:
    """Box (x1, y1, x2, y2), confidence, and 17 keypoints (x, y, confidence) in the order of KEYPOINTS."""

    box: tuple[float, float, float, float]
    conf: float
    keypoints: list[tuple[float, float, float]]


class PoseBackend(Protocol):
    def __call__(self, frames: list[bytes]) -> list[list[Person]]:
        """People of each frame."""


BACKENDS: dict[str, Callable[[], PoseBackend]] = {}


def register(name: str) -> Callable[[Callable[[], PoseBackend]], Callable[[], PoseBackend]]:
    """Make a backend's factory known by name."""

    def put(factory: Callable[[], PoseBackend]) -> Callable[[], PoseBackend]:
        BACKENDS[name] = factory
        return factory

    return put


FOUND = T.StructType([
    T.StructField("video_id", T.LongType()), T.StructField("frame_idx", T.LongType()), T.StructField("t", T.DoubleType()),
    *[T.StructField(c, T.FloatType()) for c in ("x1", "y1", "x2", "y2", "conf")], *[T.StructField(c, T.ArrayType(T.FloatType())) for c in ("kp_x", "kp_y", "kp_c")],
])


def find_people(frames: DataFrame, factory: Callable[[], PoseBackend], batch: int = 8, least: float = 0.25) -> DataFrame:
    """People surely enough seen in frames (video_id, frame_idx, t, image). A task makes one model and feeds it ``batch`` frames at a time."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            rows = []
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                for f, people in zip(some.itertuples(), model(list(some.image)), strict=True):
                    for p in people:
                        if len(p.keypoints) != len(KEYPOINTS):
                            raise ValueError(f"{len(p.keypoints)} keypoints")
                        if p.conf >= least:
                            rows.append((f.video_id, f.frame_idx, f.t, *p.box, p.conf, *map(list, zip(*p.keypoints, strict=True))))
            yield pd.DataFrame(rows, columns=FOUND.names)

    return frames.select("video_id", "frame_idx", "t", "image").mapInPandas(run, FOUND)
