"""Joins by time: as-of, nearest, interval; each shuffles on (key, time bucket) or key, never a cross join.

Keys are equi-join columns. ``nearest`` and ``interval`` bucket time, so that one
long video is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _stacked(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str]) -> DataFrame:
    """Rows of both sides: right ones carry ``p``, left ones ``l``."""
    own = [c for c in left.columns if c not in by and c != time]
    p = F.struct(F.col(time).alias("r_time"), *[F.col(c) for c in payload])
    rows = left.select(*by, time, F.lit(1).alias("is_left"), F.struct(*own).alias("l"))
    others = right.select(*by, time, F.lit(0).alias("is_left"), p.alias("p"))
    return rows.unionByName(others, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], forward: bool = False, tie: str | None = None) -> DataFrame:
    """left, with r_time and payload of right's last row at or before (forward: first at or after) left's time; null without one.

    One shuffle, one sort. Of right rows at one time the one with the largest (forward: smallest) ``tie`` wins.
    """
    both = _stacked(left, right, by, time, payload)
    key = [time, "is_left" if not forward else F.col("is_left").desc()]
    if tie:
        key.append(F.col(f"p.{tie}"))
    w = Window.partitionBy(*by).orderBy(*key)
    if forward:
        found = F.first("p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        found = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("f", found).where("is_left = 1")
    return out.select(*by, time, "l.*", "f.*")


def _bucket(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def interval(points: DataFrame, spans: DataFrame, by: list[str], time: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """points x spans with lo <= time <= hi. Spans are copied to the buckets of ``width`` that they touch; a point is in one, so no pair comes twice."""
    p = points.withColumn("__b", _bucket(F.col(time), width))
    s = spans.withColumn("__b", F.explode(F.sequence(_bucket(F.col(lo), width), _bucket(F.col(hi), width))))
    keys = [p[c] == s[c] for c in (*by, "__b")]
    joined = p.join(s, [*keys, p[time] >= s[lo], p[time] <= s[hi]], how)
    return joined.drop(*[s[c] for c in (*by, "__b")]).drop("__b")


def nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, payload: list[str], tolerance: float, ident: str) -> DataFrame:
    """left inner right's nearest row within ``tolerance``; ties go to the earlier row. Adds r_time and payload.

    ``ident`` is a unique column of left.
    """
    spans = left.withColumn("__lo", F.col(time) - tolerance).withColumn("__hi", F.col(time) + tolerance)
    width = max(tolerance * 4, 1e-9)
    r = right.select(*by, F.col(time).alias("r_time"), *payload)
    pairs = interval(r, spans, by, "r_time", "__lo", "__hi", width)
    best = F.min_by(F.struct("r_time", *payload), F.struct(F.abs(F.col("r_time") - F.col(time)), F.col("r_time"), *payload))
    keep = [c for c in left.columns if c != ident]
    grouped = pairs.groupBy(ident).agg(*[F.first(c).alias(c) for c in keep], best.alias("__best"))
    return grouped.select(*left.columns, "__best.*")


def overlap(a: DataFrame, b: DataFrame, by: list[str], width: float, a_lo: str, a_hi: str, b_lo: str, b_hi: str) -> DataFrame:
    """Pairs of intervals that overlap (ends included). A pair is emitted in the first bucket that both touch, so it comes once."""
    x = a.withColumn("__b", F.explode(F.sequence(_bucket(F.col(a_lo), width), _bucket(F.col(a_hi), width))))
    y = b.withColumn("__b", F.explode(F.sequence(_bucket(F.col(b_lo), width), _bucket(F.col(b_hi), width))))
    first = x["__b"] == F.greatest(_bucket(x[a_lo], width), _bucket(y[b_lo], width))
    cond = [x[c] == y[c] for c in (*by, "__b")] + [x[a_hi] >= y[b_lo], x[a_lo] <= y[b_hi], first]
    return x.join(y, cond).drop(*[y[c] for c in (*by, "__b")]).drop("__b")


def interpolate(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """left with ``value`` of right interpolated linearly at left's time; clamped at right's ends, null without right rows."""
    before = asof(left, right, by, time, [value]).withColumnRenamed("r_time", "__bt").withColumnRenamed(value, "__bv")
    both = asof(before, right, by, time, [value], forward=True).withColumnRenamed("r_time", "__at").withColumnRenamed(value, "__av")
    share = F.when(F.col("__at") > F.col("__bt"), (F.col(time) - F.col("__bt")) / (F.col("__at") - F.col("__bt"))).otherwise(F.lit(0.0))
    inside = F.col("__bv") + (F.col("__av") - F.col("__bv")) * share
    return both.withColumn(value, F.coalesce(inside, F.col("__bv"), F.col("__av"))).drop("__bt", "__bv", "__at", "__av")
