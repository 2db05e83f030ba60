"""Approximate nearest neighbours by a permutation index (operator 13).

A vector is represented by the order in which it sees the pivots: the ``NEAREST`` of
up to ``PIVOTS`` that lie nearest to it, nearest first. Vectors that see the pivots in a
like order lie near each other.

1. Pivots are drawn from a bounded sample (``SAMPLE`` rows by hash), the only part of
   the index that is fitted on a sample. Every row is indexed.
2. The index: rows are dealt into segments of bounded size by a hash of the row, so
   that no source, label or group of copies weighs on one of them. A segment posts
   each vector in the inverted files of its pivots, as (row of the segment, place of
   the pivot in its order); it is stored as one row of a Parquet table, which every
   pass reads without a shuffle.
3. Queries go in blocks of a proven size (``vectors.BLOCK``, ``BLOCK_BYTES``), one
   broadcast a block. In each segment the postings of the query's pivots give the
   footrule distance to all rows: pivots that only one of two orders holds count as if
   they came right after its end, so each posting of a shared pivot at places i and j
   lowers the distance by 2 * (NEAREST - max(i, j)) from its greatest value.
4. The rows of a segment at the smallest footrule distances, ``SHARE`` of them and all
   that are as near as the last, meet the original vectors and are ranked by exact
   Euclidean distance. A task keeps the best of each query over its segments; the best
   of all tasks are the result.

SHARE grows the candidates with the rows, and equal footrule distances stay together,
so copies of a vector are all ranked exactly or not at all. Recall against brute force
is measured in ``tests/llm/test_permutations.py`` (the README has figures).

Defined results: rows with a null id, or a vector that is null, empty, zero, or has a
component that is null or not finite, take no part; rows equal in id and vector count
once; a row that shares a query's id isn't its neighbour; a query meets only vectors of
its own length; lengths that the sample lacks have no pivots, so all their rows are
ranked exactly; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rallyplan.llm.common import discard, stored
from rallyplan.llm.vectors import by_length, finite, first, query_blocks

PIVOTS, NEAREST = 256, 64
#: Rows that pivots are drawn from.
SAMPLE = 4096
#: Share of the rows that are ranked by their exact distance.
SHARE = 0.2
MOST = 10
#: Rows of a segment, and bytes of its vectors, on average at most.
SEGMENT, SEGMENT_BYTES = 1 << 12, 1 << 22
SCHEMA = "query_id long, rank int, vec_id long, score double"


class Segment(NamedTuple):
    """Rows of one vector length: ids, vectors and the inverted files (rows and places of pivot p from starts[p] to starts[p + 1])."""

    ids: np.ndarray
    x: np.ndarray
    starts: np.ndarray
    rows: np.ndarray
    places: np.ndarray


def usable(rows: DataFrame, query: Column, key: str, vector: str) -> DataFrame:
    """vec_id, x, query, code (a hash of id and x) of the rows that take part, repeated ones once."""
    out = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("x"), F.coalesce(query, F.lit(False)).alias("query"))
    some = F.exists("x", lambda c: c != 0)
    return out.where(F.col("vec_id").isNotNull() & finite(F.col("x")) & some).dropDuplicates(["vec_id", "x"]).withColumn("code", F.xxhash64("vec_id", "x"))


def pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for each vector length: distinct vectors of the sample, in order of their hash, half of them at most."""
    drawn: dict[int, dict[tuple, None]] = {}
    for r in rows.select("x").orderBy(F.xxhash64("code", "x")).limit(SAMPLE).collect():
        drawn.setdefault(len(r.x), {})[tuple(r.x)] = None
    return {d: np.array(list(own)[: min(PIVOTS, len(own) // 2)]).reshape(-1, d) for d, own in drawn.items()}


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x (down) and y (across), quick and rounded; only orders are made of them."""
    with np.errstate(over="ignore", invalid="ignore"):
        return (x**2).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y**2).sum(axis=1)


def orders(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row, nearest first, of equally near ones the first."""
    if not len(own):
        return np.zeros((len(x), 0), np.int64)
    return np.argsort(squares(x, own), axis=1, kind="stable")[:, :NEAREST]


def posted(ids: np.ndarray, x: np.ndarray, own: np.ndarray) -> Segment:
    """The segment's inverted files."""
    order = orders(x, own)
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    rows, places = np.divmod(by, max(1, order.shape[1]))
    return Segment(ids, x, np.searchsorted(flat[by], np.arange(len(own) + 1)), rows, places)


def shared(segment: Segment, order: np.ndarray) -> np.ndarray:
    """Half of what the shared pivots take from the greatest footrule distance, for each row of the segment."""
    spans = [slice(a, b) for a, b in zip(segment.starts[order].tolist(), segment.starts[order + 1].tolist(), strict=True)]
    if not spans:
        return np.zeros(len(segment.ids), np.int64)
    rows = np.concatenate([segment.rows[s] for s in spans])
    later = np.concatenate([np.maximum(segment.places[s], i) for i, s in enumerate(spans)])
    return np.bincount(rows, len(order) - later, len(segment.ids)).astype(np.int64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q in double precision."""
    with np.errstate(over="ignore"):
        apart = x - q
        out = np.sqrt((apart**2).sum(axis=1))
    far = np.isinf(out)
    if far.any():  # squares beyond the range of doubles
        halves = np.abs(x[far] / 2 - q / 2)
        most = halves.max(axis=1)
        with np.errstate(over="ignore"):
            out[far] = 2 * most * np.sqrt(((halves / most[:, None]) ** 2).sum(axis=1))
    return out


def nearest(segment: Segment, query_id: int, q: np.ndarray, order: np.ndarray, share: float = SHARE, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(distances, ids) of the segment's rows nearest to the query, nearest first, ties by id."""
    near = shared(segment, order)
    n = min(len(near), max(math.ceil(share * len(near)), most + 1))
    at = np.flatnonzero((near >= np.partition(near, len(near) - n)[len(near) - n]) & (segment.ids != query_id))
    far = distances(segment.x[at], q)
    first = np.lexsort((segment.ids[at], far))[:most]
    return far[first], segment.ids[at][first]


PARTS = {"ids": np.int64, "x": np.float64, "starts": np.int32, "rows": np.int32, "places": np.int16}


def index(rows: DataFrame, own: dict[int, np.ndarray]) -> DataFrame:
    """One row for each segment and vector length: d and the parts of Segment as binary columns."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(own)
    n, components = rows.agg(F.count("*"), F.sum(F.size("x"))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = max(tasks, math.ceil(n / SEGMENT), math.ceil(8 * (components or 0) / SEGMENT_BYTES))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, made = table.column("vec_id").to_numpy(), []
        for d, (at, x) in by_length(table.column("x").combine_chunks()).items():
            order = np.argsort(ids[at], kind="stable")
            of = posted(ids[at][order], x[order], sent.value.get(d, np.zeros((0, d))))
            made.append((d, *(np.ascontiguousarray(part, kind).tobytes() for part, kind in zip(of, PARTS.values(), strict=True))))
        columns = list(zip(*made, strict=True)) or [()] * (1 + len(PARTS))
        return pa.table([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], ["d", *PARTS])

    dealt = rows.select("vec_id", "x", F.pmod(F.xxhash64("code"), F.lit(segments)).alias("segment"))
    return dealt.groupBy("segment").applyInArrow(run, ", ".join(["d long", *(f"{c} binary" for c in PARTS)]))


def search(segments: DataFrame, block: list[Row], own: dict[int, np.ndarray]) -> DataFrame:
    """query_id, rank, vec_id, score of the block's queries."""
    spark = segments.sparkSession
    lengths = {d: [i for i, r in enumerate(block) if len(r.x) == d] for d in {len(r.x) for r in block}}
    packed = {}
    for d, at in lengths.items():
        x = np.array([block[i].x for i in at])
        packed[d] = np.array(at), np.array([block[i].vec_id for i in at]), x, orders(x, own.get(d, np.zeros((0, d))))
    sent = spark.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        queries: dict[int, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                d = row.pop("d")
                if d not in sent.value:
                    continue
                parts = {c: np.frombuffer(row[c], kind) for c, kind in PARTS.items()}
                segment = Segment(**parts | {"x": parts["x"].reshape(-1, d)})
                for at, key, q, order in zip(*sent.value[d], strict=True):
                    far, ids = nearest(segment, key, q, order)
                    if at in best:
                        far, ids = (np.concatenate(x) for x in zip(best[at], (far, ids), strict=True))
                        first = np.lexsort((ids, far))[:MOST]
                        far, ids = far[first], ids[first]
                    best[at], queries[at] = (far, ids), key
        for at, (far, ids) in best.items():
            made = [pa.array(np.full(len(ids), at)), pa.array(np.full(len(ids), queries[at])), pa.array(ids), pa.array(far)]
            yield pa.RecordBatch.from_arrays(made, ["q", "query_id", "vec_id", "score"])

    found = segments.mapInArrow(run, "q long, query_id long, vec_id long, score double")
    return first(found, ["q"], MOST, F.col("score"), F.col("vec_id")).select("query_id", "rank", "vec_id", "score")


def neighbours(rows: DataFrame, query: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the MOST nearest rows found of each query; ``query``: which rows are queries."""
    spark = rows.sparkSession
    kept, place = stored(usable(rows, query, key, vector), "vectors")
    own = pivots(kept)
    segments, files = stored(index(kept, own), "segments")
    out = spark.createDataFrame([], SCHEMA)
    for block in query_blocks(kept.where("query").select("vec_id", "code", "x"), "x"):
        found, _ = stored(search(segments, block, own), "nearest")
        out = out.unionByName(found)
    discard(spark, place)
    discard(spark, files)
    return out
