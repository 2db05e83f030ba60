"""Robust and guarded aggregates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def half_even(x: Column, digits: int) -> Column:
    """Round half to even; noise beyond nine digits doesn't decide a tie."""
    nine = F.rint(x.cast("double") * F.lit(1e9)) / F.lit(1e9)
    return F.rint(nine * F.lit(float(f"1e{digits}"))) / F.lit(float(f"1e{digits}")) + F.lit(0.0)


def least_support(n: int, of: str, value: Column) -> Column:
    """The aggregate ``value`` if at least n values of the column are known, else null."""
    return F.when(F.count(of) >= n, value)


def upper_median(column: str | Column) -> Column:
    """The middle value, of an even number the upper one."""
    values = F.sort_array(F.array_compact(F.collect_list(column)))
    return F.when(F.size(values) > 0, F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int")))


def nearest_rank(column: str, share: float) -> Column:
    """The value at index (n - 1) * share, rounded half to even: never interpolated."""
    values = F.sort_array(F.collect_list(column))
    at = F.bround((F.size(values) - 1) * F.lit(share), 0).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(values, at))


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, votes: the most frequent value of each group; ties go to the smaller one."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counted.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("less"), value)).alias("b"))
    return best.select(*by, F.col(f"b.{value}").alias(value), (-F.col("b.less")).alias("votes"))


def vector_agg(df: DataFrame, by: list[str], vector: str, agg: Column, name: str) -> DataFrame:
    """An element-wise aggregate of vectors; ``agg`` is over the column x (and others)."""
    flat = df.select("*", F.posexplode(vector).alias("i", "x"))
    cells = flat.groupBy(*by, "i").agg(agg.alias("v"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias(name))
