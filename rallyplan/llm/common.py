"""Helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that are parts of words (digits, letters, all above ASCII); A-Z become a-z, the rest blanks.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folded_words(raw: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of A-Z-lowered UTF-8."""
    return raw.translate(WORD_BYTES).split()


def ready_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; a folder of this machine only in local mode and where none is named (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rallyplan-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and drop the lineage."""
    ready_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as Parquet in the shared checkpoint folder (so that later passes read only the columns they need), and the path."""
    spark = df.sparkSession
    ready_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: A key is heavy with more than 1 / HEAVY of the rows, and at least LEAST_HEAVY: there are fewer than HEAVY of them.
HEAVY, LEAST_HEAVY = 1000, 1000
#: Rows of (hash, key) that are broadcast at most; more go by a shuffle.
FEW = 1_000_000


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Inner join on a key that has one row in right; the rows of a heavy key of left don't meet in one task.

    Heavy keys are fewer than HEAVY, so their rows of right are broadcast; the others meet by a shuffle.
    Rows with a null key have no match. rows: how many left has at most, if that is known.
    """
    rows = left.count() if rows is None else rows
    least = max(LEAST_HEAVY, rows // HEAVY)
    if rows <= least:
        return left.join(right, key)
    heavy = [r[0] for r in left.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > least) & F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return left.join(right, key)
    hot = F.col(key).isin(heavy)
    return left.where(~hot).join(right, key).unionByName(left.where(hot).join(F.broadcast(right.where(hot)), key))


def matched(rows: DataFrame, few: DataFrame, same: Callable[[DataFrame, DataFrame], Column], how: str = "left_semi") -> DataFrame:
    """The rows that meet one of ``few`` (narrow rows): broadcast if they are at most FEW, else by a shuffle."""
    few = F.broadcast(few) if few.count() <= FEW else few
    return rows.join(few, same(rows, few), how)


def unmatched(rows: DataFrame, few: DataFrame, same: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """The rows that meet none of ``few``."""
    return matched(rows, few, same, "left_anti")


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list[np.ndarray]]]]:
    """(key, parts) of the runs of rows that are equal in the first ``keys`` columns, for sorted rows.

    A part is a list of columns; runs of one row may be left out.
    """
    held: list[list[np.ndarray]] = []
    last: tuple = ()
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])
        edges = np.concatenate(([0], np.flatnonzero(new) + 1, [batch.num_rows]))
        # the first and the last run may go on in other batches; of the others those of one row don't matter
        for g in sorted({0, len(edges) - 2, *np.flatnonzero(np.diff(edges) > 1).tolist()}):
            part = [c[edges[g] : edges[g + 1]] for c in columns]
            key = tuple(c[0] for c in part[:keys])
            if held and key == last:
                held.append(part)
                continue
            if held:
                yield last, held
            held, last = [part], key
    if held:
        yield last, held


#: What a pass over texts reads, and hands to Python, at once.
SHORT = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within take texts in batches of bounded size.

    A task holds a batch several times (columns, Arrow vectors, the buffer to Python, the worker); by Spark's default it has 10,000 rows, up to 64 MB of text.
    """
    before = {k: spark.conf.get(k) for k in SHORT}
    try:
        for k, v in SHORT.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that what a step holds stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_text(df: DataFrame, key: str, text: str, schema: str, row: Callable[[], Callable[[bytes], tuple]]) -> DataFrame:
    """Map each (key, text) row to key + row()(UTF-8 bytes). ``row`` is a factory that runs once a task.

    schema names the columns after the key.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = row()
        for batch in slices(batches):
            made = [of(x) for x in raw_texts(batch.column(1))]
            columns = list(zip(*made, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    from pyspark.sql.pandas.types import to_arrow_schema

    full = f"`{key}` {kind}, {schema}"
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], full).schema)
    types, names = [f.type for f in arrow][1:], arrow.names
    return df.select(key, text).mapInArrow(run, full)
