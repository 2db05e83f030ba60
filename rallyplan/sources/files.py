"""Read paths: columnar tables with a contract, time slices, documents, label files, folders of recordings."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyplan.functions.text import clock_seconds

SLICE_S = 30.0


def contract(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with its declared schema; only ``columns`` are read. Columns that older files lack are null."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of a contract, in its types; those that df lacks are null."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def time_slice(df: DataFrame, start: float, end: float, time: str = "t") -> DataFrame:
    """Rows of [start, end), at most SLICE_S long; the bounds are pushed into the scan."""
    return df.where((F.col(time) >= start) & (F.col(time) < min(end, start + SLICE_S)))


def documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON rows, one a line, also gzipped, with a declared schema."""
    return spark.read.schema(schema).json(path)


def labels(spark: SparkSession, path: str) -> DataFrame:
    """A label file: CSV with a header, ``#`` comments and blank lines skipped, clock times as seconds in ``t``."""
    df = spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.withColumn("t", clock_seconds(F.col("t"))) if "t" in df.columns else df


def arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, values) of .npy files with one array of numbers each; a file is held whole by the task that reads it."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.load(io.BytesIO(x), allow_pickle=False).astype(float).ravel() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["path", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(load, "path string, values array<double>")


def long_envelope(df: DataFrame, rate: float = 200.0) -> DataFrame:
    """(path, t, strength) of arrays read by ``arrays``."""
    return df.select("path", F.posexplode("values").alias("frame", "strength")).select("path", (F.col("frame") / rate).alias("t"), "strength")


def library(spark: SparkSession, path: str, used: DataFrame) -> DataFrame:
    """Recordings in a folder, newest first, with the sessions that use them (``used``: path, session_id). Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    done = files.where(~F.col("path").endswith(".part"))
    by_path = used.groupBy("path").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return done.join(by_path, "path", "left").orderBy(F.desc("modificationTime"), "path")
