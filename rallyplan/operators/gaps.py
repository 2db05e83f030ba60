"""Sessions by gaps, gaps and islands, run lengths: window functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyplan.schema import LIMITS, Thresholds


def ordered(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def running(by: list[str], order: list[str]) -> Window:
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def number_groups(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Number, from 0, of the group that each row is in; ``starts`` says where a group starts (a first row always does)."""
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(running(by, order)) - F.first(F.when(starts, 1).otherwise(0)).over(running(by, order)))


def continues_rally(gap: Column, side: Column, before: Column, limits: Thresholds = LIMITS) -> Column:
    """A hit so long after the one before belongs to its rally; a longer gap is allowed if the same side hits again (one hit was missed)."""
    missed = (gap <= limits.missed_hit_gap_s) & side.isNotNull() & before.isNotNull() & side.eqNullSafe(before)
    return F.coalesce((gap <= limits.rally_gap_s) | missed, F.lit(False))


def sessionize(df: DataFrame, by: list[str], time: str, tie: str, side: str, serve: Column, limits: Thresholds = LIMITS) -> DataFrame:
    """Add gap, first, rally, pos. ``first``: the gap rule alone starts a rally; a serve starts one as well."""
    w = ordered(by, [time, tie])
    out = df.withColumn("gap", F.col(time) - F.lag(time).over(w)).withColumn("before", F.lag(side).over(w))
    out = out.withColumn("first", F.col("gap").isNull() | ~continues_rally(F.col("gap"), F.col(side), F.col("before"), limits)).drop("before")
    out = number_groups(out, by, [time, tie], F.col("first") | serve, "rally")
    return out.withColumn("pos", F.row_number().over(ordered([*by, "rally"], [time, tie])) - 1)


def islands(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Number the runs of equal consecutive values."""
    change = ~F.col(value).eqNullSafe(F.lag(value).over(ordered(by, order))) | F.lag(F.lit(1)).over(ordered(by, order)).isNull()
    return number_groups(df.withColumn("__change", change), by, order, F.col("__change"), name).drop("__change")


def run_lengths(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, island, value, n of every run of equal consecutive values."""
    return islands(df, by, order, value).groupBy(*by, "island").agg(F.first(value).alias(value), F.count("*").alias("n"))


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Unions of intervals that overlap, or lie at most ``gap`` apart: by, start, end, n."""
    seen = F.max(end).over(ordered(by, [start, end]).rowsBetween(Window.unboundedPreceding, -1))
    grouped = number_groups(df.withColumn("__new", F.coalesce(F.col(start) > seen + gap, F.lit(True))), by, [start, end], F.col("__new"), "__group")
    return grouped.groupBy(*by, "__group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__group")


def fill_gaps(df: DataFrame, by: list[str], time: str, value: str, most: int) -> DataFrame:
    """Fill interior runs of at most ``most`` missing values by linear interpolation over time; adds ``filled``."""
    w = ordered(by, [time])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    missing = F.col(value).isNull().cast("int")
    out = df.withColumn("__b", before).withColumn("__a", after)
    out = out.withColumn("__run", F.sum(1 - missing).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("__n", F.sum(missing).over(Window.partitionBy(*by, "__run")))
    share = (F.col(time) - F.col("__b.t")) / (F.col("__a.t") - F.col("__b.t"))
    lerp = F.col("__b.v") + (F.col("__a.v") - F.col("__b.v")) * share
    ok = F.col(value).isNull() & F.col("__b").isNotNull() & F.col("__a").isNotNull() & (F.col("__n") <= most)
    return out.withColumn("filled", F.when(ok, lerp).otherwise(F.col(value))).drop("__b", "__a", "__run", "__n")
