"""Near copies by the Gray-order SimHash index and exact similarity (the pipeline's near-dedup stage).

Two texts are near copies if the sets of their ``SHINGLE``-word shingles have a
Jaccard similarity of ``LEAST_JACCARD`` or more; near copies of near copies are in
one component. Words are those of the SimHash operator; a text of fewer words is
one shingle, all texts without words are equal.

1. One pass over the texts: a code of the shingle set, its size, its SimHash of
   ``WORDS`` * 64 bits, and ``BANDS`` hashes of ``ROWS`` MinHash values each.
2. Bands deal the distinct sets (however many texts share one). Sets of similarity
   0.8 differ in 0.15 of their SimHash bits on average, far more than blocks of
   agreeing bits can deal, as they do within 2 bits for operator 10; they share a
   band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99978.
3. Each text goes once to each of its bands that another set shares. There the
   hierarchical index of ``simhash`` finds the pairs within ``RADIUS`` bits of
   components that are still apart, in vectorised blocks. Pairs whose sizes rule out
   the similarity go, then those whose sketches do (the least hash in each of ``BINS``
   ranges: the share of equal ones estimates the similarity, and a pair goes if it is
   ``SIGMAS`` standard deviations of such an estimate below 0.8). What is left is compared set by set,
   until it is of one component.
4. Bands with more than ``CHUNK_ROWS`` sets or ``CHUNK_SHINGLES`` shingles are thinned
   first: neighbours in their Gray orders are compared, for ``TURNS`` orders, and bands
   that then hold one component are done. The others are cut into chunks in order of
   component and Gray rank, and each pair of chunks, but those of one component, is
   searched as in 3.

No pair is linked without comparing the shingle sets themselves, and none is left
out for the size of its band; only links leave a task, never candidates of the
search. ``RADIUS`` is six standard deviations beyond the mean distance at
similarity 0.8. What a band costs grows with the square of its distinct sets only in
the two bit counts and byte comparisons of steps that numpy does by blocks, and only
among texts that look alike without being near copies.

Defined results: of each component one row stays, the one with the smallest key
(null last), then the smallest hash of its columns; of rows equal in all columns
one stays; an empty table gives an empty table; other columns are kept; texts of any
length are taken whole (eight bytes a shingle while a task compares them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import cut, groups, matched, raw_texts, slices, spread_join
from rallyplan.llm.simhash import UPPER, Forest, GrayIndex, components, gray_code, gray_rank, keep_first, row_code

#: Words of a shingle.
SHINGLE = 5
#: Similarity from which on texts are near copies, as a fraction.
LEAST_JACCARD = (4, 5)
ROWS, BANDS = 4, 16
SEED = 42
#: SimHash of so many 64-bit words; pairs within so many bits are compared.
WORDS, RADIUS = 2, 44
#: Bins of a sketch, and how far below the least similarity a pair's estimate may be, in standard deviations.
BINS, SIGMAS = 512, 6
#: Node pairs that are expanded, and pairs whose sketches are compared, at once: what a task holds stays at some MB.
PAIRS = 1 << 12
#: Bits that the words are turned by for each round of nearest neighbours in large bands.
TURNS = (0, 32)
#: Sets of a band that one chunk holds, and their shingles.
CHUNK_ROWS, CHUNK_SHINGLES = 1 << 13, 1 << 21
#: Bands beyond that size that are named in a filter; if there are more, all bands are cut into runs.
LARGE_BANDS = 1000
#: Shingles that are hashed at once, and pairs that are emitted at once.
CHUNK = 1 << 14

_pick = np.random.default_rng(SEED)
_FACTORS = _pick.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _pick.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
_SIGN = np.uint64(1 << 63)


def shingles(raw: bytes) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes."""
    words = [w for w in raw.translate(UPPER).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    flat, hashed, seed = b" ".join(words), xxhash.xxh64_intdigest, SEED
    if len(words) <= SHINGLE:
        return np.array([hashed(flat, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-SHINGLE])).tolist()
    return np.unique(np.array([hashed(flat[a:b], seed) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def set_code(own: np.ndarray) -> int:
    """The set's own code as a signed 64-bit integer; 0 for no words."""
    code = xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0
    return code - (1 << 64) if code >> 63 else code


def band_codes(own: np.ndarray) -> list[int]:
    """A signed 64-bit code of each band; none for no words."""
    if not len(own):
        return []
    least = np.full(ROWS * BANDS, ~np.uint64(0))
    for at in range(0, len(own), CHUNK // 8):
        np.minimum(least, ((own[at : at + CHUNK // 8, None] ^ _MASKS) * _FACTORS).min(axis=0), out=least)
    codes = [xxhash.xxh64_intdigest(x.tobytes(), b) for b, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(codes, np.uint64).view(np.int64).tolist()


def fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of the set in WORDS words; the second and later words come from the shingles' hashes mixed again."""
    out = np.zeros(WORDS, np.uint64)
    codes = own
    for w in range(WORDS):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(codes), CHUNK // 2):
            ones += np.unpackbits(codes[at : at + CHUNK // 2].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(codes)).view(">u8")[0]
        codes = (codes ^ (codes >> np.uint64(31))) * _FACTORS[w]
        codes ^= codes >> np.uint64(29)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Is the sets' Jaccard similarity LEAST_JACCARD or more?"""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST_JACCARD[1] >= (len(a) + len(b) - both) * LEAST_JACCARD[0]


def sketch(own: np.ndarray) -> np.ndarray:
    """16 bits of the least hash in each of BINS ranges; 0 where there is none."""
    out = np.zeros(BINS, np.uint16)
    if len(own):
        bins = (own >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        least = np.flatnonzero(np.diff(bins, prepend=-1))  # the set is sorted
        out[bins[least]] = own[least].astype(np.uint16) | np.uint16(1)
    return out


def hopeful(x: np.ndarray, y: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """May the sets of these sketches (rows) be near copies? shingles: of both sets together.

    The filled bins hold a random sample, drawn without replacement, of the union; the
    equal ones are those of the intersection (and a few equal by chance).
    """
    filled = np.count_nonzero(x | y, axis=1)
    same = np.count_nonzero((x == y) & (x > 0), axis=1)
    least = LEAST_JACCARD[0] / LEAST_JACCARD[1]
    union = np.maximum(shingles / (1 + least), filled)
    return same >= least * filled - SIGMAS * np.sqrt(least * (1 - least) * filled * (union - filled + 1) / union)


def _signed(words: np.ndarray) -> np.ndarray:
    """Unsigned words as signed ones of the same order."""
    return (words ^ _SIGN).view(np.int64)


def _turned(ranks: np.ndarray, turn: int) -> np.ndarray:
    """Gray ranks of the codes at these ranks after each word is turned left."""
    if not turn:
        return ranks
    codes = gray_code(ranks)
    return gray_rank((codes << np.uint64(turn)) | (codes >> np.uint64(64 - turn)))


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, content, code, n, g0, g1 (Gray rank of the SimHash, as signed words), bands of every row."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["content", "code", "n", *(f"g{w}" for w in range(WORDS)), "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(x) for x in raw_texts(batch.column(2))]
            ranks = _signed(gray_rank(np.array([fingerprint(x) for x in sets], np.uint64).reshape(-1, WORDS)))
            made = [pa.array([set_code(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(ranks[:, w]) for w in range(WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array([band_codes(x) for x in sets], pa.list_(pa.int64()))], ["k", *names])

    schema = ", ".join([f"k {kind}", *(f"{x} long" for x in names[:-1]), "bands array<long>"])
    return docs.select(F.col(f"`{key}`"), row_code(docs), F.col(f"`{text}`")).mapInArrow(run, schema)


def _unsigned(columns: list[np.ndarray]) -> np.ndarray:
    return np.stack(columns, axis=1).view(np.uint64) ^ _SIGN


def _neighbours(members: DataFrame, turn: int) -> DataFrame:
    """(a, b), a < b: neighbours in the bands' Gray orders within RADIUS, of fitting sizes and of different components; of each set the nearest.

    members: band, g0, g1, n, code, root. Sorted by ranges of (band, rank), so that a band of any size spreads
    over tasks; the few neighbours at the borders of tasks are left to the search.
    """
    spark = members.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = [f"g{w}" for w in range(WORDS)]

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _signed(_turned(_unsigned([batch.column(1 + w).to_numpy() for w in range(WORDS)]), turn))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(own[:, w]) for w in range(WORDS)), *batch.columns[1 + WORDS :]], batch.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if before is not None:
                rows = [np.concatenate(x) for x in zip(before, rows, strict=True)]
            before = [c[-1:] for c in rows]
            band, *g, n, code, root = rows
            codes = gray_code(_unsigned(g))
            far = np.bitwise_count(codes[1:] ^ codes[:-1]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(n[1:], n[:-1]), np.maximum(n[1:], n[:-1])
            good = (band[1:] == band[:-1]) & (root[1:] != root[:-1]) & (far <= RADIUS) & (small * LEAST_JACCARD[1] >= large * LEAST_JACCARD[0])
            a, b = code[:-1][good], code[1:][good]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far[good])], ["a", "b", "far"])

    rows = members.select("band", *ranks, "n", "code", "root")
    rows = rows.mapInArrow(turned, rows.schema) if turn else rows
    pairs = rows.repartitionByRange(tasks, "band", *ranks).sortWithinPartitions("band", *ranks, "code").mapInArrow(run, "a long, b long, far long")
    other = F.max_by(F.struct("a", "b"), F.struct(-F.col("far"), "a", "b"))
    best = pairs.select(F.explode(F.array("a", "b")).alias("own"), "a", "b", "far").groupBy("own").agg(other.alias("x"))
    return best.select("x.a", "x.b").distinct()


def _large(members: DataFrame) -> list[int] | None:
    """Bands that are too large for one chunk; none: they are too many to be named."""
    sizes = members.groupBy("band").agg(F.count("*").alias("rows"), F.sum("n").alias("held"))
    out = [r.band for r in sizes.where((F.col("rows") > CHUNK_ROWS) | (F.col("held") > CHUNK_SHINGLES)).select("band").limit(LARGE_BANDS + 1).collect()]
    return out if len(out) <= LARGE_BANDS else None


def _chunks(members: DataFrame) -> DataFrame:
    """members with a chunk number: runs of a band by (root, Gray rank) of bounded size."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "root", *(f"g{w}" for w in range(WORDS)), "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, rows, held, last = TaskContext.get().partitionId() << 40, 0, 0, None
        for batch in batches:
            out = np.empty(batch.num_rows, np.int64)
            for i, (band, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(len(order)).to_pylist(), strict=True)):
                if band != last or rows == CHUNK_ROWS or held + n > CHUNK_SHINGLES:
                    chunk, rows, held, last = chunk + 1, 0, 0, band
                out[i], rows, held = chunk, rows + 1, held + n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "chunk"])

    kinds = ", ".join(f"{c} long" for c in [*order, "n"])
    return members.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select(*order, "n").mapInArrow(run, f"{kinds}, chunk long")


def _dealt(members: DataFrame, large: list[int] | None) -> DataFrame:
    """chunk_a, chunk_b, chunk, n, code, root and ranks: the sets that one step of the search takes together.

    A band of bounded size is one such step; of a larger one each pair of its chunks is, but those of one component.
    """
    columns = ["chunk_a", "chunk_b", "chunk", "n", "code", "root", *(f"g{w}" for w in range(WORDS))]
    inside = members.withColumns({c: F.col("band") for c in columns[:3]}).select(columns)
    if large == []:
        return inside
    hot = F.lit(True) if large is None else F.col("band").isin(large)
    chunked = cut(_chunks(members.where(hot)))
    table = cut(chunked.groupBy("band", "chunk").agg(F.min("root").alias("low"), F.max("root").alias("high")))  # one row a chunk
    left, right = (table.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("chunk", "low", "high"))) for s in "ab")
    whole = "low_a = high_a AND low_b = high_b AND low_a = low_b"
    pairs = left.join(right, "band").where(f"chunk_a <= chunk_b AND NOT ({whole})").select("chunk_a", "chunk_b")
    sides = pairs.select(F.explode(F.expr("array_distinct(array(chunk_a, chunk_b))")).alias("chunk"), "chunk_a", "chunk_b")
    return inside.where(~F.col("chunk").isin(large) if large else F.lit(False)).unionByName(sides.join(chunked, "chunk").select(columns))


def _search(members: DataFrame, texts: DataFrame, large: list[int] | None) -> DataFrame:
    """(a, b): links that join all near copies that share a band; by a Gray index for each step."""
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranks = [f"g{w}" for w in range(WORDS)]
    met = spread_join(_dealt(members, large), texts, "code", members.count() if large == [] else None)
    dealt = met.repartition(tasks, "chunk_a", "chunk_b").sortWithinPartitions("chunk_a", "chunk_b", *ranks, "code")

    def found(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        pair_a, pair_b, chunk, n, code, root, *g, text = (np.concatenate(c) for c in zip(*parts, strict=True))
        both = pair_a[0] != pair_b[0]
        index = GrayIndex(gray_code(_unsigned(g)))
        names, own = np.unique(root, return_inverse=True)
        forest, sets, out = Forest(len(names)), {}, []
        sketches = np.zeros((len(code), BINS), np.uint16)

        def known(rows: np.ndarray) -> None:
            for i in rows.tolist():
                if i not in sets:
                    sets[i] = shingles((text[i] or "").encode())
                    sketches[i] = sketch(sets[i])

        for a, b in index.near(RADIUS, lambda: forest.roots()[own], PAIRS):
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            good = small * LEAST_JACCARD[1] >= large * LEAST_JACCARD[0]
            if both:  # pairs within one chunk are searched once, with the chunk itself
                good &= chunk[a] != chunk[b]
            a, b = a[good], b[good]
            if not len(a):
                continue
            known(np.unique(np.concatenate([a, b])))
            good = np.concatenate([hopeful(sketches[a[i : i + PAIRS]], sketches[b[i : i + PAIRS]], (n[a] + n[b])[i : i + PAIRS]) for i in range(0, len(a), PAIRS)])
            a, b = a[good], b[good]
            order = np.argsort(np.bitwise_count(index.codes[a] ^ index.codes[b]).sum(axis=1, dtype=np.int64), kind="stable")
            for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
                x, y = int(own[i]), int(own[j])
                if forest.top(x) != forest.top(y) and alike(sets[i], sets[j]):
                    forest.link(x, y)
                    out.append((code[i], code[j]))
        links = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, 2):
            yield found(parts)

    return cut(dealt.select("chunk_a", "chunk_b", "chunk", "n", "code", "root", *ranks, "t").mapInArrow(run, "a long, b long"))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are near copies, cut; texts: (code, t)."""
    left, right = texts.select(F.col("code").alias("a"), F.col("t").alias("x")), texts.select(F.col("code").alias("b"), F.col("t").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sides = [[shingles(z) for z in raw_texts(batch.column(c))] for c in (2, 3)]
            yield batch.select([0, 1]).filter(pa.array([alike(x, y) for x, y in zip(*sides, strict=True)], pa.bool_()))

    n = pairs.count()
    met = spread_join(pairs, left, "a", n).select("a", "b", "x")
    return cut(spread_join(met, right, "b", n).select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of bands that have several components, with their root."""
    found = roots.select(F.col("node").alias("code"), F.col("root").alias("found"))
    rooted = cut(members.drop("root").join(found, "code", "left").withColumn("root", F.coalesce("found", "code")).drop("found"))
    several = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    return cut(spread_join(rooted, several, "band"))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, content, root of every row: rows whose texts are near copies share the root."""
    marked = cut(_marked(docs, key, text))
    ranks = [f"g{w}" for w in range(WORDS)]
    distinct = marked.groupBy("code", "n", *ranks, "bands").agg(F.min("content").alias("content"))
    placed = distinct.select("code", "content", "n", *ranks, F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    members = cut(spread_join(placed, shared, "band").withColumn("root", F.col("code")))
    chosen = members.select("content", "code").distinct()
    rows = docs.select(row_code(docs).alias("own"), F.col(f"`{text}`").alias("t"))
    texts = matched(rows, chosen, lambda a, b: a.own == b.content, "inner").select("code", "t").dropDuplicates(["code"])
    left, large, links = members.drop("content"), _large(members), None
    if large != []:
        texts = cut(texts)
        for turn in TURNS:
            hot = left if large is None else left.where(F.col("band").isin(large))
            found = _links(cut(_neighbours(hot, turn)), texts)
            links = found if links is None else cut(links.unionByName(found))
            left = _open(left, components(links))
        large = _large(left)
    found = _search(left, texts, large)
    roots = components(found if links is None else found.unionByName(links))
    return marked.join(roots, marked.code == roots.node, "left").select(F.col("k").alias(key), "content", F.coalesce("root", "code").alias("root"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows, with all their columns, such that one row of each component stays."""
    return keep_first(docs, cut(near_copies(docs, key, text)), key)
