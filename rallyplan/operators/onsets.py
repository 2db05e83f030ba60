"""Onsets in sound that comes in chunks; the result doesn't depend on how it was cut.

Sound is cut into frames of ``hop`` samples, counted from the start of the video. A
frame's level is the mean power of the differences of neighbouring samples (a simple high
pass), in dB; its strength is how much the level rose. An onset is a frame that is the
strongest within ``APART`` frames on both sides (of equals the first) and beats the median
plus ``K`` median absolute deviations of the ``HALF`` frames before and after it.

``levels`` and ``onsets`` do this for all videos at once by columns: each chunk adds up its
part of its frames, sums of one frame meet in one small aggregate, windows do the rest. A
chunk borrows one sample from the chunk before it, so a difference across their border is
the same as within. ``Picker`` does it sample by sample for a stream (``streaming.onsets``).

Defined results: null samples are silence; after a missing chunk the first difference is
zero, as at the start; frames without a sample have no level and are left out; chunks
may come in any order in a table; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.operators.robust import half_even

HALF, APART, K = 10, 2, 6.0
#: Least median absolute deviation (dB), and power that counts as silence.
LEAST_MAD, SILENCE = 0.5, 1e-12


def levels(chunks: DataFrame, hop: int) -> DataFrame:
    """video_id, frame, level_db. chunks: video_id, start (number of the first sample), samples (array)."""
    c = chunks.select("video_id", "start", F.transform("samples", lambda x: F.coalesce(x.cast("double"), F.lit(0.0))).alias("x")).where(F.size("x") > 0)
    w = Window.partitionBy("video_id").orderBy("start")
    c = c.withColumn("end", F.col("start") + F.size("x"))
    borrowed = F.when(F.lag("end").over(w) == F.col("start"), F.lag(F.element_at("x", -1)).over(w))
    c = c.withColumn("before", F.concat(F.array(F.coalesce(borrowed, F.get("x", F.lit(0)))), F.slice("x", 1, F.size("x") - 1)))
    c = c.withColumn("d", F.zip_with("x", "before", lambda a, b: a - b))

    def part(f: Column) -> Column:
        low, high = F.greatest(f * hop, F.col("start")), F.least((f + 1) * hop, F.col("end"))
        own = F.slice("d", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
        return F.struct(f.alias("frame"), F.aggregate(own, F.lit(0.0), lambda total, d: total + d * d).alias("power"), (high - low).alias("n"))

    frames = F.transform(F.sequence(F.floor(F.col("start") / hop).cast("long"), F.floor((F.col("end") - 1) / hop).cast("long")), part)
    power = F.sum("power") / F.sum("n")
    parts = c.select("video_id", F.explode(frames).alias("p")).select("video_id", "p.*")
    return parts.groupBy("video_id", "frame").agg(half_even(10 * F.log10(F.greatest(power, F.lit(SILENCE))), 6).alias("level_db"))


def _middle(values: Column) -> Column:
    s, n = F.sort_array(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def onsets(levels_: DataFrame) -> DataFrame:
    """video_id, frame, strength, threshold of the onsets."""
    w = Window.partitionBy("video_id").orderBy("frame")
    rise = half_even(F.greatest(F.col("level_db") - F.coalesce(F.lag("level_db").over(w), F.col("level_db")), F.lit(0.0)), 6)
    s = levels_.withColumn("strength", rise)
    s = s.withColumns({"around": F.collect_list("strength").over(w.rowsBetween(-HALF, HALF)), "earlier": F.max("strength").over(w.rowsBetween(-APART, -1)), "later": F.max("strength").over(w.rowsBetween(1, APART))})
    s = s.withColumn("median", _middle(F.col("around")))
    spread = _middle(F.transform("around", lambda v: F.abs(v - F.col("median"))))
    s = s.withColumn("threshold", F.col("median") + K * F.greatest(spread, F.lit(LEAST_MAD)))
    top = (F.col("strength") > F.coalesce("earlier", F.lit(-1.0))) & (F.col("strength") >= F.coalesce("later", F.lit(-1.0)))
    return s.where(top & (F.col("strength") > F.col("threshold"))).select("video_id", "frame", "strength", half_even(F.col("threshold"), 6).alias("threshold"))


def _rounded(x: float, digits: int = 6) -> float:
    return float(np.rint(np.rint(x * 1e9) / 1e9 * 10.0**digits) / 10.0**digits + 0.0)


class Picker:
    """The same onsets, chunk by chunk; what it carries is bounded: some 2 * HALF strengths, a frame's sums, one sample."""

    def __init__(self, hop: int):
        self.hop, self.end, self.sample = hop, None, 0.0
        self.frame, self.power, self.n, self.level = None, 0.0, 0, None
        self.frames: list[int] = []
        self.strengths: list[float] = []
        self.told = 0  # of ``frames``, how many are judged already

    def saved(self) -> str:
        return json.dumps(vars(self))

    @classmethod
    def restored(cls, text: str) -> Picker:
        out = cls(0)
        vars(out).update(json.loads(text))
        return out

    def feed(self, start: int, samples: list[float | None]) -> Iterator[tuple[int, float, float]]:
        """(frame, strength, threshold) of the onsets that are certain with these samples."""
        x = np.array([0.0 if v is None else v for v in samples], float)
        if not len(x):
            return
        d = np.diff(x, prepend=self.sample if self.end == start else x[0])
        at = (start + np.arange(len(x))) // self.hop
        for f in np.unique(at).tolist():
            own = d[at == f]
            if f != self.frame:
                self._finish()
                self.frame, self.power, self.n = f, 0.0, 0
            for v in own.tolist():
                self.power += v * v
            self.n += len(own)
        self.end, self.sample = int(start + len(x)), float(x[-1])
        yield from self._judge(HALF)

    def close(self) -> Iterator[tuple[int, float, float]]:
        """Those that only the end of the sound makes certain."""
        self._finish()
        self.frame = None
        yield from self._judge(0)

    def _finish(self) -> None:
        if self.frame is None:
            return
        level = _rounded(10 * float(np.log10(max(self.power / self.n, SILENCE))))
        self.frames.append(self.frame)
        self.strengths.append(_rounded(max(level - (level if self.level is None else self.level), 0.0)))
        self.level = level

    def _judge(self, ahead: int) -> Iterator[tuple[int, float, float]]:
        while self.told < len(self.frames) - ahead:
            i, s = self.told, self.strengths
            around = np.array(s[max(0, i - HALF) : i + HALF + 1])
            median = float(np.median(around))
            threshold = median + K * max(float(np.median(np.abs(around - median))), LEAST_MAD)
            if s[i] > threshold and s[i] > max(s[max(0, i - APART) : i], default=-1.0) and s[i] >= max(s[i + 1 : i + 1 + APART], default=-1.0):
                yield self.frames[i], s[i], _rounded(threshold)
            self.told += 1
        gone = max(0, self.told - HALF)
        self.frames, self.strengths, self.told = self.frames[gone:], self.strengths[gone:], self.told - gone
