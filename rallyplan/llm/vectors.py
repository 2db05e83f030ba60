"""Rows with vectors, as the vector operators (12 and 13) take them, and the queries among them, a block at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows serves, and the bytes of their vectors: what is broadcast at once.
BLOCK, BLOCK_BYTES = 1 << 13, 1 << 23


def finite(x: Column) -> Column:
    """Has the vector components, none of them null, NaN or infinite?"""
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    return x.isNotNull() & (F.size(x) > 0) & F.coalesce(good, F.lit(False))


def query_blocks(queries: DataFrame, vector: str) -> Iterator[list[Row]]:
    """The rows of ``queries`` in blocks by hash, of about BLOCK rows and BLOCK_BYTES bytes at most; never all at once.

    queries: a stored table with ``code``, a hash of the row.
    """
    n, components = queries.agg(F.count("*"), F.sum(F.size(vector))).first()
    blocks = max(1, math.ceil(n / BLOCK), math.ceil(8 * (components or 0) / BLOCK_BYTES))
    for b in range(blocks if n else 0):
        rows = queries.where(F.pmod("code", F.lit(blocks)) == b).collect()
        if rows:
            yield sorted(rows, key=lambda r: (r.vec_id, r.code))


def by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vector length -> (rows, matrix) of a column of double arrays."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = rows, flat[(starts[rows, None] + np.arange(d)).ravel()].reshape(-1, d)
    return out


def first(rows: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each key, with their rank; Spark cuts each task's rows to as many before it shuffles them."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
