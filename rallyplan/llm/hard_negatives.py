"""Hard negatives by a vector-approximation file (operator 12).

For each anchor: its positives (the ``POSITIVES`` rows of its label with the highest
scores) and for each positive the ``NEGATIVES`` best rows of other labels whose score
lies in a window below the positive's. A score is the inner product of the vectors
``floor(SCALE * x)``, as an integer.

1. The file. Each dimension is cut into at most ``CELLS`` cells, at quantiles of a
   bounded sample of ``SAMPLE`` rows; the outermost ones end at the least and greatest
   value of all rows. A row's approximation is a byte a dimension. Approximations and
   vectors are columns of one Parquet table, so a pass that needs approximations
   doesn't read the vectors.
2. Anchors go in blocks of a proven size (``vectors.BLOCK`` rows, ``BLOCK_BYTES``),
   one broadcast a block; a block's result is written before the next one starts.
3. Positives. A pass over the approximations looks up each cell's middle and half
   width in the table; middle . |anchor| terms give every score a lower and an upper
   bound. A row goes on if its upper bound reaches the fifth best lower bound of its
   anchor, first among the rows that the task has seen, then among those of all tasks.
   Only these candidates meet their vectors (a join by row) and are scored exactly.
4. Negatives in the same manner, with the windows that the exact positives give: a row
   goes on if its bounds touch a window and reach the fifth best lower bound of the
   rows that lie in that window for certain.

Bounds are widened by what floating-point sums can be off by, so the cells decide
only how many rows are scored, never the result. Of rows that share label and vector
only those with the smallest ids can be returned, so of the copies within one batch no
more go on than one anchor may need; the copies' number makes nothing grow.

Defined results: rows with a null id or label, a null or empty vector, or a component
that is null or not finite (also after scaling) take no part; rows equal in id, label
and vector count once; rows that share an anchor's id are neither its positives nor
its negatives; an anchor meets only vectors of its own length; scores beyond 64 bits
are cut off at the ends of their range; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rallyplan.llm.common import FEW, discard, stored
from rallyplan.llm.vectors import by_length, finite, first, query_blocks

POSITIVES, NEGATIVES = 5, 5
SCALE = 256.0
#: A negative's score lies between so many percent of the positive's and the positive's.
LOW_PERCENT, HIGH_PERCENT = 80, 100
#: Cells of a dimension, and the rows whose quantiles bound them.
CELLS, SAMPLE = 256, 4096
#: Rows whose bounds are computed at once, anchors likewise, and candidates that a task holds until it looks through them again.
ROWS, ANCHORS, HELD = 2048, 512, 1 << 20
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
INF = float("inf")
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Limits(NamedTuple):
    """A dimension's cells of vectors of one length: edges (d, up to CELLS - 1; padded with inf), low and high (d, CELLS)."""

    edges: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Anchors(NamedTuple):
    """Anchors of one vector length: their places in the block, ids, labels (sorted), vectors."""

    at: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray


def scaled(vector: Column) -> Column:
    """floor(SCALE * component) as doubles; those from 2 ** 52 on are whole already."""
    return F.transform(vector.cast("array<double>"), lambda c: F.when(F.abs(c * SCALE) < float(1 << 52), F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))


def usable(rows: DataFrame, anchor: Column, key: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, anchor, x, code (a hash of label and x), same (of x): the rows that take part, repeated ones once."""
    x = F.when(finite(F.col(f"`{vector}`").cast("array<double>")), scaled(F.col(f"`{vector}`")))
    out = rows.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"))
    out = out.where(finite(F.col("x")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).dropDuplicates(["vec_id", "label", "x"])
    return out.withColumns({"code": F.xxhash64("label", "x"), "same": F.xxhash64("x")})


def cell_limits(rows: DataFrame) -> dict[int, Limits]:
    """Cells for each vector length: quantiles of the sample, ends by the least and greatest values of all rows."""
    ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, (_, x) in by_length(batch.column(0)).items():
                low, high = own.setdefault(d, [x[0].copy(), x[0].copy()])
                np.minimum(low, x.min(axis=0), out=low)
                np.maximum(high, x.max(axis=0), out=high)
        for d, (low, high) in own.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(low), pa.array(high)], ["d", "j", "low", "high"])

    found = rows.select("x").mapInArrow(run, "d long, j long, low double, high double").groupBy("d", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for r in found.collect():  # one row for each dimension
        low, high = ends.setdefault(r.d, (np.zeros(r.d), np.zeros(r.d)))
        low[r.j], high[r.j] = r.low, r.high
    sample: dict[int, list[list[float]]] = {}
    for r in rows.select("x").orderBy(F.xxhash64("vec_id", "code")).limit(SAMPLE).collect():
        sample.setdefault(len(r.x), []).append(r.x)
    return {d: limits(np.array(sample.get(d, []), np.float64).reshape(-1, d), low, high) for d, (low, high) in ends.items()}


def limits(sample: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> Limits:
    """Cells between quantiles of the sample; every value between least and greatest lies in the cell that its edges say."""
    d = len(least)
    edges, low, high = np.full((d, CELLS - 1), INF), np.repeat(least[:, None], CELLS, axis=1), np.repeat(greatest[:, None], CELLS, axis=1)
    for j in range(d if len(sample) else 0):
        own = np.unique(np.quantile(sample[:, j], np.arange(1, CELLS) / CELLS, method="higher"))
        edges[j, : len(own)] = own
        low[j, 1 : len(own) + 1] = own
        # components are whole numbers; below 2 ** 52 the largest one under an edge is one less
        high[j, : len(own)] = np.where(np.abs(own) < 2.0**52, own - 1, own)
    return Limits(edges, low, np.maximum(high, low))


def cells(x: np.ndarray, of: Limits) -> np.ndarray:
    """The cell of each component, a byte each."""
    return np.stack([np.searchsorted(e, column, side="right") for e, column in zip(of.edges, x.T, strict=True)], axis=1).astype(np.uint8)


def approximated(rows: DataFrame, of: dict[int, Limits]) -> DataFrame:
    """The rows with their approximation ``cells``."""
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.empty(batch.num_rows, object)
            for d, (at, x) in by_length(batch.column(names.index("x"))).items():
                for i, row in zip(at.tolist(), cells(x, sent.value[d]), strict=True):
                    own[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], [*names, "cells"])

    names = rows.columns
    return rows.mapInArrow(run, ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), "cells binary"]))


def packed(block: list[Row]) -> dict[int, Anchors]:
    """The block's anchors by vector length, sorted by label."""
    out = {}
    for d in {len(r.x) for r in block}:
        at = np.array(sorted((i for i, r in enumerate(block) if len(r.x) == d), key=lambda i: (block[i].label, i)))
        own = [block[i] for i in at]
        out[d] = Anchors(at, np.array([r.vec_id for r in own]), np.array([r.label for r in own]), np.array([r.x for r in own]))
    return out


class Batch(NamedTuple):
    """Approximations of rows of one vector length, as they go on: of copies (label and vector) only those with the smallest ids."""

    ids: np.ndarray
    codes: np.ndarray
    labels: np.ndarray
    middle: np.ndarray
    half: np.ndarray
    slack: float


def read_batches(batches: Iterator[pa.RecordBatch], of: dict[int, Limits], copies: int) -> Iterator[tuple[int, Batch]]:
    """(vector length, Batch) for rows vec_id, code, same, label, cells, ROWS at most at a time."""
    for batch in batches:
        ids, codes, same, labels = (c.to_numpy() for c in batch.columns[:4])
        raw = batch.column(4)
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, same, labels))
        new = np.concatenate(([True], (np.diff(labels[order]) != 0) | (np.diff(same[order]) != 0)))
        start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        kept = order[np.arange(len(order)) - start < copies]
        for d in np.unique(lengths[kept]).tolist():
            own, table = kept[lengths[kept] == d], of[d]
            for a in range(0, len(own), ROWS):
                at = own[a : a + ROWS]
                x = np.frombuffer(b"".join(raw.take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, d)
                low, high = table.low[np.arange(d), x], table.high[np.arange(d), x]
                # halves first: sums of the largest doubles would overflow
                yield d, Batch(ids[at], codes[at], labels[at], low / 2 + high / 2, high / 2 - low / 2, float(np.abs([low, high]).max(initial=0)))


def bounds(batch: Batch, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of the batch's rows (down) with the anchors x (across)."""
    size = np.abs(x)
    with np.errstate(over="ignore", invalid="ignore"):
        middle, half = batch.middle @ x.T, batch.half @ size.T
        # d products are summed twice; each step is off by at most one part in 2 ** 52
        half += x.shape[1] * (x.shape[1] + 4) * batch.slack * size.max(axis=1, initial=0) * 2.0**-50
        low, high = middle - half, middle + half
    return tuple(np.clip(np.where(np.isnan(b), none, b), LEAST, MOST) for b, none in ((low, -INF), (high, INF)))  # as scores are cut off


class Pool:
    """Candidates (anchor's place in the block, id, code, lower and upper bound) that a task holds."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(list(columns))
            self.n += len(columns[0])

    def look_through(self, keep) -> None:
        """Only those stay for which keep(anchor, low, high) holds."""
        if self.parts:
            rows = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
            good = keep(rows[0], rows[3], rows[4])
            self.parts = [[c[good] for c in rows]]
            self.n = int(good.sum())

    def batches(self) -> Iterator[pa.RecordBatch]:
        for part in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in part], ["a", "vec_id", "code", "low", "high"])


CANDIDATES = "a long, vec_id long, code long, low double, high double"


def best_of(top: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The best lower bounds of each anchor (down; ascending), joined with those of new rows (down; anchors across)."""
    most = top.shape[1]
    if len(low) > most:
        low = np.partition(low, len(low) - most, axis=0)[-most:]
    return np.sort(np.concatenate([top, low.T], axis=1), axis=1)[:, -most:]


def possible_positives(file: DataFrame, anchors: dict[int, Anchors], size: int, of: dict[int, Limits]) -> DataFrame:
    """Candidates of each task for the block's positives; size: how many anchors the block has."""
    sent = file.sparkSession.sparkContext.broadcast((anchors, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = sent.value
        pool, top = Pool(), np.full((size, POSITIVES), -INF)
        keep = lambda a, low, high: high >= top[a, 0]
        # an anchor may be among its own copies
        for d, batch in read_batches(batches, table, POSITIVES + 1):
            if d not in block:
                continue
            own = block[d]
            for label in np.intersect1d(batch.labels, own.labels).tolist():
                rows = np.flatnonzero(batch.labels == label)
                of_label = Batch(*(c[rows] for c in batch[:5]), batch.slack)
                first, last = np.searchsorted(own.labels, [label, label + 1] if label < MOST else [label, MOST], side="left").tolist()
                last = last if label < MOST else len(own.labels)
                for i in range(first, last, ANCHORS):
                    j = min(last, i + ANCHORS)
                    low, high = bounds(of_label, own.x[i:j])
                    itself = of_label.ids[:, None] == own.ids[None, i:j]
                    low[itself], high[itself] = -INF, -INF
                    at = own.at[i:j]
                    top[at] = best_of(top[at], low)
                    r, c = np.nonzero((high >= top[at, 0]) & ~itself)
                    pool.add(at[c], of_label.ids[r], of_label.codes[r], low[r, c], high[r, c])
            if pool.n > HELD:
                pool.look_through(keep)
        pool.look_through(keep)
        yield from pool.batches()

    return file.select("vec_id", "code", "same", "label", "cells").mapInArrow(run, CANDIDATES)


def possible_negatives(file: DataFrame, anchors: dict[int, Anchors], windows: np.ndarray, of: dict[int, Limits]) -> DataFrame:
    """Candidates of each task for the block's negatives; windows: (anchors, POSITIVES, 2), inf and -inf where there is none."""
    sent = file.sparkSession.sparkContext.broadcast((anchors, windows, of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, window, table = sent.value
        size, (floor, ceiling) = len(window), np.moveaxis(window, 2, 0)
        pool, top = Pool(), np.full((POSITIVES, size, NEGATIVES), -INF)
        inner = lambda edge, way: edge + way * np.where(np.isfinite(edge), np.abs(edge), 0) * 1e-12

        def keep(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(a), bool)
            for k in range(POSITIVES):
                out |= (high >= np.maximum(inner(floor[a, k], -1), top[k, a, 0])) & (low <= inner(ceiling[a, k], 1))
            return out

        for d, batch in read_batches(batches, table, NEGATIVES):
            if d not in block:
                continue
            own = block[d]
            for i in range(0, len(own.at), ANCHORS):
                at = own.at[i : i + ANCHORS]
                low, high = bounds(batch, own.x[i : i + ANCHORS])
                least, most = inner(np.maximum(floor[at], top[:, at, 0].T), -1).min(axis=1), inner(ceiling[at], 1).max(axis=1)
                r, c = np.nonzero((high >= least) & (low <= most) & (batch.labels[:, None] != own.labels[None, i : i + ANCHORS]) & (batch.ids[:, None] != own.ids[None, i : i + ANCHORS]))
                a, low, high = at[c], low[r, c], high[r, c]
                for k in range(POSITIVES):
                    sure = np.flatnonzero((low >= inner(floor[a, k], 1)) & (high <= inner(ceiling[a, k], -1)))
                    sure = sure[np.lexsort((-low[sure], a[sure]))]
                    starts = np.flatnonzero(np.diff(a[sure], prepend=-1))
                    place = np.arange(len(sure)) - np.repeat(starts, np.diff(starts, append=len(sure)))
                    sure, place = sure[place < NEGATIVES], place[place < NEGATIVES]
                    found = np.full((size, NEGATIVES), -INF)
                    found[a[sure], place] = low[sure]
                    some = np.unique(a[sure])
                    top[k, some] = np.sort(np.concatenate([top[k, some], found[some]], axis=1), axis=1)[:, -NEGATIVES:]
                good = keep(a, low, high)
                pool.add(a[good], batch.ids[r[good]], batch.codes[r[good]], low[good], high[good])
            if pool.n > HELD:
                pool.look_through(keep)
        pool.look_through(keep)
        yield from pool.batches()

    return file.select("vec_id", "code", "same", "label", "cells").mapInArrow(run, CANDIDATES)


def products(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Exact inner products of rows of whole numbers, cut off at the ends of 64 bits."""
    with np.errstate(over="ignore"):
        whole = x.shape[1] * np.abs(x).max(initial=0) * np.abs(y).max(initial=0) < 2.0**53
    if whole:
        return np.einsum("ij,ij->i", x, y).astype(np.int64).tolist()
    return [min(MOST, max(LEAST, sum(int(a) * int(b) for a, b in zip(u, v, strict=True)))) for u, v in zip(x.tolist(), y.tolist(), strict=True)]


def exact(candidates: DataFrame, file: DataFrame, anchors: dict[int, Anchors]) -> DataFrame:
    """a, anchor_id, vec_id, score of the candidates (a, vec_id, code), by their vectors."""
    sent = file.sparkSession.sparkContext.broadcast(anchors)
    few = candidates.select("a", "vec_id", "code")
    few = F.broadcast(few) if few.count() <= FEW else few
    rows = file.select("vec_id", "code", "x").join(few, ["vec_id", "code"]).select("a", "vec_id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d, (at, x) in by_length(batch.column(2)).items():
                own = sent.value[d]
                place = np.argsort(own.at)[np.searchsorted(np.sort(own.at), a[at])]
                made = [pa.array(a[at]), pa.array(own.ids[place]), pa.array(ids[at]), pa.array(products(x, own.x[place]), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, ["a", "anchor_id", "vec_id", "score"])

    return rows.mapInArrow(run, "a long, anchor_id long, vec_id long, score long")


def block_negatives(file: DataFrame, block: list[Row], of: dict[int, Limits]) -> DataFrame:
    """The result's rows for one block of anchors."""
    spark, anchors = file.sparkSession, packed(block)
    found, place = stored(possible_positives(file, anchors, len(block), of), "positives")
    by_bound = [F.col("low").desc(), F.col("vec_id"), F.col("code")]
    needed = first(found, ["a"], POSITIVES, *by_bound).where(F.col("rank") == POSITIVES).select("a", F.col("low").alias("least"))
    near = found.join(F.broadcast(needed), "a", "left").where("least IS NULL OR high >= least")  # a row an anchor of the block at most
    scored = exact(near, file, anchors)
    best = first(scored, ["a"], POSITIVES, F.col("score").desc(), F.col("vec_id")).select("a", F.col("rank").alias("k"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).collect()  # POSITIVES an anchor of the block
    discard(spark, place)
    windows = np.tile(np.array([INF, -INF]), (len(block), POSITIVES, 1))
    for r in best:
        windows[r.a, r.k - 1] = r.positive_score * LOW_PERCENT / 100, r.positive_score * HIGH_PERCENT / 100
    positives = F.broadcast(spark.createDataFrame(best, "a long, k int, anchor_id long, positive_id long, positive_score long"))
    found, place = stored(possible_negatives(file, anchors, windows, of), "negatives")
    times = lambda c, n: F.col(c).cast("decimal(38,0)") * n
    edge = lambda percent: F.col("positive_score").cast("double") * (percent / 100)
    margin = F.abs(F.col("positive_score").cast("double")) * 1e-12
    placed = found.join(positives.select("a", "k", "positive_score"), "a")
    sure = placed.where((F.col("low") >= edge(LOW_PERCENT) + margin) & (F.col("high") <= edge(HIGH_PERCENT) - margin))
    needed = first(sure, ["a", "k"], NEGATIVES, *by_bound).where(F.col("rank") == NEGATIVES).select("a", "k", F.col("low").alias("least"))
    inside = (F.col("high") >= edge(LOW_PERCENT) - margin) & (F.col("low") <= edge(HIGH_PERCENT) + margin)
    near = placed.join(F.broadcast(needed), ["a", "k"], "left").where(inside & (F.col("least").isNull() | (F.col("high") >= F.col("least")))).select("a", "vec_id", "code").distinct()
    scored = exact(near, file, anchors).drop("anchor_id").join(positives, "a")
    window = (times("positive_score", LOW_PERCENT) <= times("score", 100)) & (times("score", 100) <= times("positive_score", HIGH_PERCENT))
    out = first(scored.where(window), ["a", "k"], NEGATIVES, F.col("score").desc(), F.col("vec_id"))
    kept, _ = stored(out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "mined")
    discard(spark, place)
    return kept


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``anchor``: which rows are anchors."""
    spark = rows.sparkSession
    kept, place = stored(usable(rows, anchor, key, vector, label), "vectors")
    of = cell_limits(kept)
    file, own = stored(approximated(kept, of), "approximations")
    discard(spark, place)
    out = spark.createDataFrame([], SCHEMA)
    for block in query_blocks(file.where("anchor").select("vec_id", "code", "label", "x"), "x"):
        out = out.unionByName(block_negatives(file, block, of))
    discard(spark, own)
    return out


def oracle() -> str:
    """The same rows in DuckDB's SQL, all scores of all anchors."""
    return f"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor({SCALE} * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank, s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND {LOW_PERCENT} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH_PERCENT} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= {NEGATIVES}"""
