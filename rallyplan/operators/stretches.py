"""Aggregates over stretches of time around hits, all of a swing's in one pass.

A swing's samples are brought together by one shuffle (none, if they are already dealt by
``hit_id``) and sorted; then NumPy works out what is asked for, for all swings of a batch at
once. As Spark's own aggregates these would be some hundred, with percentiles among them,
which Spark evaluates row by row without generated code.

What can be asked for, each by the name of its column in the result:

    Mean(value, at, within)             mean of the values within so many seconds of a moment
    Top(value, lo, hi)                  the largest value of a stretch
    Bend(corners, lo, hi, share, least) percentile (interpolated) of the angles ABC (as ``geometry.angle``; of each corner x and y of A, B, C) of a stretch together; null under ``least``
    Pace(x, y, lo, hi, share, least)    percentile of the speeds between samples of a stretch in which x is known; 0 under ``least`` of those
    Turn(ax, ay, bx, by, moments, within, drawn, turned)   widths between two points' mean places at moments: <name>_n and
                                        <name>_drawn (how many, and the least, of the moments before ``drawn``), <name>_turned (the largest after ``turned``)

Defined results: null values don't count; NaN counts and is larger than all else, as in
Spark; sums run in order of ``rel``; no samples, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Known = tuple[np.ndarray, np.ndarray]


class Swings:
    """A batch of whole swings: rel, and for each row the number of its swing."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        first = batch.column("n").to_numpy() == 1
        self.first, self.of = np.flatnonzero(first), np.cumsum(first) - 1
        self.rel = self.value("rel")[0]
        self.count = len(self.first)

    def value(self, name: str) -> Known:
        """A column's numbers, and where they are known (rel: NaN, which is within nothing, where not)."""
        column = self.batch.column(name)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        return column.fill_null(np.nan if name == "rel" else 0.0).to_numpy(zero_copy_only=False), known

    def between(self, lo: float, hi: float) -> np.ndarray:
        return (self.rel >= lo) & (self.rel <= hi)

    def near(self, at: float, within: float) -> np.ndarray:
        return np.abs(self.rel - at) <= within

    def number(self, rows: np.ndarray) -> np.ndarray:
        """How many of these rows each swing has."""
        return np.bincount(self.of[rows], minlength=self.count)

    def mean(self, value: Known, near: np.ndarray) -> Known:
        rows = np.flatnonzero(near & value[1])
        n = self.number(rows)
        return np.bincount(self.of[rows], value[0][rows], self.count) / np.maximum(n, 1), n > 0

    def percentile(self, of: np.ndarray, values: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the values of each swing, and their number."""
        n = np.bincount(of, minlength=self.count)
        values = values[np.lexsort((values, of))]
        at = np.maximum(n - 1, 0) * share
        low, high, start = np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64), np.cumsum(n) - n
        if not len(values):
            return np.zeros(self.count), n
        below, above = (values[np.minimum(start + k, len(values) - 1)] for k in (low, high))
        return np.where(low == high, below, (high - at) * below + (at - low) * above), n


class Mean(NamedTuple):
    value: str
    at: float
    within: float

    def columns(self, name: str) -> list[str]:
        return [name]

    def told(self, s: Swings) -> list[Known]:
        return [s.mean(s.value(self.value), s.near(self.at, self.within))]


class Top(NamedTuple):
    value: str
    lo: float
    hi: float

    def columns(self, name: str) -> list[str]:
        return [name]

    def told(self, s: Swings) -> list[Known]:
        v, known = s.value(self.value)
        rows = known & s.between(self.lo, self.hi)
        return [(np.maximum.reduceat(np.where(rows, v, -np.inf), s.first), s.number(rows) > 0)]


class Bend(NamedTuple):
    corners: tuple[tuple[str, ...], ...]
    lo: float
    hi: float
    share: float
    least: int

    def columns(self, name: str) -> list[str]:
        return [name]

    def told(self, s: Swings) -> list[Known]:
        pairs = []
        for points in self.corners:
            values = [s.value(p) for p in points]
            rows = np.flatnonzero(np.logical_and.reduce([known for _, known in values]) & s.between(self.lo, self.hi))
            ax, ay, bx, by, cx, cy = (v[rows] for v, _ in values)
            ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
            n = np.hypot(ux, uy) * np.hypot(vx, vy)
            long = ~(n <= 0)
            pairs.append((s.of[rows][long], np.degrees(np.arccos(np.fmin(1.0, np.maximum(-1.0, (ux * vx + uy * vy) / n))))[long]))
        found, n = s.percentile(*(np.concatenate(x) for x in zip(*pairs, strict=True)), self.share)
        return [(found, n >= max(self.least, 1))]


class Pace(NamedTuple):
    x: str
    y: str
    lo: float
    hi: float
    share: float
    least: int

    def columns(self, name: str) -> list[str]:
        return [name]

    def told(self, s: Swings) -> list[Known]:
        (x, known), (y, level) = s.value(self.x), s.value(self.y)
        rows = np.flatnonzero(known & s.between(self.lo, self.hi))
        of, x, y, level, t = (a[rows] for a in (s.of, x, y, level, s.rel))
        step = (of[1:] == of[:-1]) & level[1:] & level[:-1]
        pace = np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2) / np.maximum(np.diff(t), 1e-3)
        found, steps = s.percentile(of[1:][step], pace[step], self.share)
        enough = np.bincount(of, minlength=s.count) >= self.least
        return [(np.where(enough, found, 0.0), ~enough | (steps > 0))]


class Turn(NamedTuple):
    ax: str
    ay: str
    bx: str
    by: str
    moments: tuple[float, ...]
    within: float
    drawn: float
    turned: float

    def columns(self, name: str) -> list[str]:
        return [f"{name}_n", f"{name}_drawn", f"{name}_turned"]

    def told(self, s: Swings) -> list[Known]:
        points = [s.value(c) for c in (self.ax, self.ay, self.bx, self.by)]
        n, drawn, turned, late = np.zeros(s.count), np.full(s.count, np.nan), np.full(s.count, -np.inf), np.zeros(s.count, bool)
        for m in self.moments:
            if not self.turned < m and not m < self.drawn:
                continue
            near = s.near(m, self.within)
            (ax, a), (ay, b), (bx, c), (by, d) = (s.mean(p, near) for p in points)
            width, known = np.hypot(bx - ax, by - ay), a & b & c & d
            if m < self.drawn:
                n += known
                drawn = np.fmin(drawn, np.where(known, width, np.nan))
            if m > self.turned:
                turned, late = np.maximum(turned, np.where(known, width, -np.inf)), late | known
        every = np.ones(s.count, bool)
        return [(n, every), (drawn, n > 0), (turned, late)]


Wanted = Mean | Top | Bend | Pace | Turn


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches that no swing goes over the end of."""
    kept = None
    for batch in batches:
        rows = batch if kept is None or not kept.num_rows else pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
        first = np.flatnonzero(rows.column("n").to_numpy() == 1)
        cut = int(first[-1]) if len(first) else 0
        if cut:
            yield rows.slice(0, cut)
        kept = rows.slice(cut)
    if kept is not None and kept.num_rows:
        yield kept


def by_swing(samples: DataFrame, values: dict[str, Column], wanted: dict[str, Wanted]) -> DataFrame:
    """hit_id and the columns of ``wanted``, doubles, one row a swing. samples: hit_id, rel and what ``values`` are made of."""
    names = [c for n, x in wanted.items() for c in x.columns(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            s = Swings(batch)
            with np.errstate(all="ignore"):
                found = [k for x in wanted.values() for k in x.told(s)]
            columns = [pa.array(np.asarray(v, float), pa.float64(), mask=~k) for v, k in found]
            yield pa.RecordBatch.from_arrays([batch.column("hit_id").take(pa.array(s.first)), *columns], ["hit_id", *names])

    rows = samples.select("hit_id", F.col("rel").cast("double").alias("rel"), *[v.cast("double").alias(n) for n, v in values.items()])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("hit_id").orderBy("rel")))
    return rows.mapInArrow(run, ", ".join([f"hit_id {dict(rows.dtypes)['hit_id']}", *(f"{n} double" for n in names)]))
