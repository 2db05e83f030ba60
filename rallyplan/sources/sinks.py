"""Write paths: replaced partitions, rewrites only on change, provenance, merges of documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyplan.operators.relational import difference, merged_maps


def replace_partitions(df: DataFrame, path: str, by: str = "session_id") -> None:
    """Put df's partitions in place of those with the same key; other sessions stay. The commit protocol makes it whole or not at all.

    Every session has a folder of its own: for many thousands of them there is ``versions.Store``, whose files don't grow with sessions.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def with_provenance(df: DataFrame, **facts: str) -> DataFrame:
    """Provenance (stage, version, settings' hash) as constant columns, dictionary-encoded to nearly nothing."""
    return df.withColumns({f"rallyplan_{k}": F.lit(v) for k, v in sorted(facts.items())})


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write unless the table there has the same rows (NaN equals NaN, null doesn't equal NaN). Returns whether it wrote."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return True
    if old.dtypes == df.dtypes:
        d = difference(old, df).first()
        if d.rows_only_old == 0 and d.rows_only_new == 0:
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def digest(df: DataFrame) -> DataFrame:
    """One row: count and order-free digest of the rows, for comparing large tables without a shuffle."""
    tagged = [F.concat_ws("|", F.col(c).isNull().cast("string"), F.col(c).cast("string")) for c in df.columns]
    h = F.xxhash64(*tagged).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).alias("digest"))


def metrics_long(df: DataFrame, key: str, metrics: str) -> DataFrame:
    """A map of metrics as (key, name, value) rows."""
    return df.select(key, F.explode(metrics).alias("name", "value"))


def merge_document(old: Column, new: Column) -> Column:
    """Shallow merge of two maps, the new one wins; null counts as empty."""
    return F.coalesce(merged_maps(old, new), new, old)


def as_json(df: DataFrame, path: str) -> None:
    """Rows as gzipped JSON lines."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


#: Seconds of a slice; most folders of one video and slice each.
SLICE_S, FOLDERS = 10.0, 1000


def write_slices(df: DataFrame, path: str, video: str = "video_id", time: str = "t") -> None:
    """Rows as one file for each video and slice of SLICE_S seconds, in order of time.

    A table with more than FOLDERS of them has a folder for each slice only, so that folders
    don't grow with videos; its files each hold a range of videos, in order of video and time,
    so a condition on the video still skips by minimum and maximum. df is read for the
    count, for the ranges and for the rows.
    """
    rows = df.withColumn("slice", F.floor(F.col(time) / SLICE_S).cast("long"))
    if rows.select(video, "slice").distinct().limit(FOLDERS + 1).count() > FOLDERS:
        rows.repartitionByRange("slice", video).sortWithinPartitions("slice", video, time).write.partitionBy("slice").parquet(path)
    else:
        rows.repartition(video, "slice").sortWithinPartitions(video, "slice", time).write.partitionBy(video, "slice").parquet(path)


def read_slices(spark: SparkSession, path: str, videos: Column, start: float, end: float, time: str = "t") -> DataFrame:
    """Rows of some videos (a condition on the video's column) with start <= time < end; the slices they can be in are the only folders read."""
    first, last = math.floor(start / SLICE_S), math.floor(end / SLICE_S)
    rows = spark.read.parquet(path).where(videos & F.col("slice").between(first, last))
    return rows.where((F.col(time) >= start) & (F.col(time) < end)).drop("slice")
