"""SimHash near-duplicates by a Gray-order hierarchical index (operator 10).

1. Fingerprints: one pass over the texts, in batches of bounded size; the table
   (doc_id, fingerprint) is cut into the shared checkpoint folder.
2. Distinct fingerprints with their smallest doc_id; however many copies share a
   fingerprint, they are one row from here on (partial aggregation first).
3. Ranges of Gray rank. The top of the index is dealt over the cluster: equal
   ranges of Gray rank that hold about ``GROUP`` fingerprints each. So that two
   fingerprints within MAX_BITS always share a range, this is done in
   MAX_BITS + 1 turns, each with another block of bits in front (3 rows of 24
   bytes a fingerprint). A range with more than ``MOST`` fingerprints is dealt
   further, by the bits of 4 of 6 blocks (15 tables, 2 ** 22 fingerprints at most
   in a group, by proof).
4. Within a range: fingerprints in Gray order under nodes of ``FANOUT`` children;
   a node holds the bits that all below it share (a mask and a pattern). Pairs of
   nodes are taken level by level; a pair goes on only if the differences on the
   shared bits don't exceed MAX_BITS, so whole groups of pairs are pruned. A pair
   whose fingerprints are all linked already is pruned, too. Each range emits a
   forest of links, never all pairs.
5. Components over the links by alternating large-star and small-star joins,
   each round cut into the checkpoint folder, until nothing changes.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null doc_id gets its component's smallest other doc_id (null if there
is none); repeated rows give repeated rows; an empty table gives an empty table;
other columns are ignored. ``keep_one`` keeps them and decides by row: of each
component one row stays, whatever doc_ids the rows share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyplan.llm.common import cut, groups, matched, per_text, raw_texts, short_batches, slices, spread_join, unmatched

MAX_BITS = 2
#: Distinct fingerprints that a range of Gray rank is to hold, and from how many on it is dealt further.
GROUP, MOST = 1 << 12, 1 << 18
#: Edges that a task joins at once.
EDGES = 1 << 20
#: 64 bits in so many blocks where a range is dealt further.
BLOCKS = 6
#: Words of a shingle.
SHINGLE = 3
SEED = 42
#: Children of an index node.
FANOUT = 8
#: Node pairs that are expanded at once, into FANOUT ** 2 times as many.
CHUNK = 1 << 12

UPPER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fingerprint(raw: bytes) -> int:
    """SimHash of the text's shingles as a signed 64-bit integer."""
    words = [w for w in raw.translate(UPPER).split(b" ") if w]
    if not words:
        return 0
    hashed, seed = xxhash.xxh64_intdigest, SEED
    if len(words) <= SHINGLE:
        hashes = [hashed(b" ".join(words), seed)]
    else:
        flat = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[: 1 - SHINGLE - 1])).tolist()
        hashes = [hashed(flat[a:b], seed) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    codes = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), 8192):
        ones += np.unpackbits(codes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes)).view(">u8")[0].astype("<u8").view("<i8"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp long."""
    return per_text(docs, key, text, "fp long", lambda: lambda raw: (fingerprint(raw),))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code (n, words; most significant first) in the reflected Gray sequence, in as many words."""
    out = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(step)
    for w in range(1, out.shape[1]):  # what the words before it have turned round
        out[:, w] ^= np.uint64(0) - (out[:, w - 1] & np.uint64(1))
    return out


def gray_code(ranks: np.ndarray) -> np.ndarray:
    """The codes at these positions."""
    out = ranks ^ (ranks >> np.uint64(1))
    out[:, 1:] ^= ranks[:, :-1] << np.uint64(63)
    return out


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up, self.flat = np.arange(n), True

    def roots(self) -> np.ndarray:
        """Of all; looked up anew only after links."""
        while not self.flat:
            higher = self.up[self.up]
            self.flat = bool((higher == self.up).all())
            self.up = higher
        return self.up

    def top(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def link(self, a: int, b: int) -> bool:
        a, b, up = self.top(a), self.top(b), self.up
        if a == b:
            return False
        up[max(a, b)], self.flat = min(a, b), False
        return True


class GrayIndex:
    """Codes (n, words) in Gray order under nodes of FANOUT children.

    A node holds the bits that all codes below it share: a mask and a pattern.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.levels = [(codes, np.full(codes.shape, ~np.uint64(0)))]
        while len(self.levels[-1][0]) > 1:
            pattern, mask = self.levels[-1]
            at = np.arange(0, len(pattern), FANOUT)
            first = np.repeat(pattern[at], FANOUT, axis=0)[: len(pattern)]
            shared = np.bitwise_and.reduceat(mask & ~(pattern ^ first), at, axis=0)
            self.levels.append((pattern[at] & shared, shared))

    def near(self, most: int, roots: Callable[[], np.ndarray], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs a < b of codes that differ in at most ``most`` bits and have different roots when they are yielded; ``chunk`` node pairs are expanded at once.

        Node pairs go down level by level. One is given up, with all pairs below
        it, as soon as the differences on its shared bits, which hold those of
        every node above, exceed ``most``, or where all its codes have one root.
        """
        n, stack = len(self.codes), [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > chunk:
                stack += [(level, a[i : i + chunk], b[i : i + chunk]) for i in range(0, len(a), chunk)]
                continue
            pattern, mask = self.levels[level]
            differ = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]).sum(axis=1, dtype=np.int64)
            a, b = a[differ <= most], b[differ <= most]
            root = roots()
            if not level:
                apart = (a < b) & (root[a] != root[b])
                if apart.any():
                    yield a[apart], b[apart]
                continue
            # smallest and largest root below the nodes of these pairs alone
            nodes, of = np.unique(np.concatenate((a, b)), return_inverse=True)
            own = root[np.minimum(nodes[:, None] * FANOUT**level + np.arange(min(n, FANOUT**level)), n - 1)]
            low, high = own.min(axis=1)[of].reshape(2, -1), own.max(axis=1)[of].reshape(2, -1)
            several = (low != high).any(axis=0) | (low[0] != low[1])
            a, b = a[several], b[several]
            children, size = np.arange(FANOUT), len(self.levels[level - 1][0])
            left = np.repeat(a[:, None] * FANOUT + children, FANOUT, axis=1).ravel()
            right = np.tile(b[:, None] * FANOUT + children, (1, FANOUT)).ravel()
            inside = (left < size) & (right < size) & (left <= right)
            if inside.any():
                stack.append((level - 1, left[inside], right[inside]))


def linked_pairs(codes: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """A spanning forest of the links (at most ``most`` differing bits) between distinct codes, as rows of two indexes."""
    rank = gray_rank(codes[:, None])[:, 0]
    order = np.argsort(rank, kind="stable")
    index, forest = GrayIndex(codes[order, None]), Forest(len(codes))
    out: list[tuple[int, int]] = []
    for a, b in index.near(most, forest.roots):
        while len(a):
            # one link for each pair of components, then look again which are still apart
            roots = forest.roots()
            pair = roots[a] * len(codes) + roots[b]
            _, first = np.unique(pair, return_index=True)
            out += [(i, j) for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True) if forest.link(i, j)]
            roots = forest.roots()
            apart = roots[a] != roots[b]
            a, b = a[apart], b[apart]
    return order[np.array(out, np.int64).reshape(-1, 2)]


def block_masks(blocks: int = BLOCKS, most: int = MAX_BITS) -> list[int]:
    """Masks of the bits that the rows of one key of a fine table share."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [sum(own[i] for i in kept) for kept in combinations(range(blocks), blocks - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_range(fp: Column, turn: int, bits: int) -> Column:
    """Which of the 2 ** bits equal ranges of Gray rank the fingerprint lies in, turned left by so many bits."""
    turned = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp
    out = F.shiftrightunsigned(turned, 64 - bits)
    for step in (1, 2, 4, 8, 16):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, step))
    return out


def in_ranges(distinct: DataFrame, n: int) -> DataFrame:
    """(fp, t, k): each fingerprint under its range of Gray rank in every turn.

    Two fingerprints that differ in at most MAX_BITS bits agree on one of
    MAX_BITS + 1 blocks of bits, so they share a range where it stands first.
    """
    parts = MAX_BITS + 1
    bits = min(64 // parts, max(0, math.ceil(math.log2(max(1, n) / GROUP))))
    if not bits:
        return distinct.select("fp", F.lit(0).alias("t"), F.lit(0).cast("long").alias("k"))
    turns = [round(i * 64 / parts) for i in range(parts)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), gray_range(F.col("fp"), turn, bits).alias("k")) for i, turn in enumerate(turns)])
    return distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")


def in_blocks(distinct: DataFrame) -> DataFrame:
    """(fp, t, k): each fingerprint under its bits of every choice of blocks; 2 ** 22 at most share a key."""
    masks = block_masks()
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)])
    return distinct.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")


def links_within(placed: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the links between the fingerprints of each (t, k), by a Gray index for each."""
    tasks = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "t", "k").sortWithinPartitions("t", "k")

    def solved(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        codes = np.concatenate(parts)
        pairs = linked_pairs(codes) if len(codes) > 1 else np.zeros((0, 2), np.int64)
        if len(pairs):
            signed = codes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[pairs[:, 0]]), pa.array(signed[pairs[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groups(batches, 2):
            yield from solved([p[2].view(np.uint64) for p in parts])

    return dealt.select("t", "k", "fp").mapInArrow(run, "a long, b long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that connect every two fingerprints that differ in at most MAX_BITS bits."""
    placed = in_ranges(distinct, distinct.count())
    full = cut(placed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("t", "k"))
    if full.isEmpty():
        return links_within(placed)
    fine = in_blocks(placed.join(full, ["t", "k"], "left_semi").select("fp").distinct())
    return links_within(placed.join(full, ["t", "k"], "left_anti")).unionByName(links_within(fine))


def forests(edges: DataFrame) -> DataFrame:
    """(u, v): each node with the smallest one that EDGES edges of its task tie it to; the components stay the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def stars() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            forest = Forest(len(nodes))
            for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
                forest.link(i, j)
            root = nodes[forest.roots()]
            return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], ["u", "v"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= EDGES:
                yield stars()
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, root): root is the smallest node that is reachable; only nodes that have a link.

    Every task first joins what its own edges tie together. Then alternating stars:
    large-star hangs each node's larger neighbours on its smallest one, small-star
    its smaller neighbours; the depth of the trees falls by half in a round. Every
    round is cut into the checkpoint folder. A hub's edges don't meet in one task
    (``spread_join``).
    """

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())

    now = cut(forests(edges.where("a <> b").distinct()).distinct())
    last = state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = spread_join(both.where("v > u"), low, "u", last[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", last[0])
        small = small.select(F.col("m").alias("v"), F.col("v").alias("u")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = cut(small)
        found = state(now)
        if found == last:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        last = found
    raise RuntimeError(f"components don't settle in {rounds} rounds")


def fingerprint_components(marked: DataFrame, key: str = "doc_id") -> DataFrame:
    """fp, root, component_id (smallest key of the component) for a cut table (key, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct))
    linked = cut(distinct.join(roots, distinct.fp == roots.node).select("fp", "least", "root"))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(spread_join(linked, named, "root").select("fp", "root", "component_id"))
    # those without a link are components of their own
    return distinct.join(told, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id of every whole text."""
    with short_batches(docs.sparkSession):
        marked = cut(fingerprints(docs, key, text))
    out = spread_join(marked, fingerprint_components(marked, key), "fp")
    return out.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def row_code(docs: DataFrame) -> Column:
    """A hash of all columns of a row."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def keep_first(docs: DataFrame, rooted: DataFrame, key: str) -> DataFrame:
    """Of the rows of each root one: with the smallest key (null last), then the smallest hash of the columns.

    rooted: cut table (key, content, root) of every row; content is row_code. The
    choice is made on this narrow table. The rows themselves are read once; few
    losers are broadcast, many meet them by a shuffle. Rows that are equal in all
    columns are told apart only by dropping repeats of those that win.
    """
    content, least = (free_name(x, docs.columns) for x in ("__content", "__least"))
    told = rooted.select(F.col(key).alias("k"), "content", "root")
    winners = told.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("bare"), "k", "content")).alias("w")).select("root", F.col("w.k").alias("wk"), F.col("w.content").alias("wc"))
    wins = F.col("k").eqNullSafe(F.col("wk")) & (F.col("content") == F.col("wc"))
    judged = cut(spread_join(told, winners, "root").withColumn("wins", wins).groupBy("k", "content", "wins").agg(F.count("*").alias("n")))
    named = lambda some: some.select(F.col("content").alias(content), F.col("k").alias(least))
    goes = judged.where("NOT wins OR n > 1")
    same = lambda a, b: (a[content] == b[content]) & a[key].eqNullSafe(b[least])
    marked = docs.withColumn(content, row_code(docs))
    kept = unmatched(marked, named(goes), same).select(docs.columns)
    again = judged.where("wins AND n > 1")
    if again.isEmpty():
        return kept
    repeated = matched(marked, named(again), same).dropDuplicates([content, key])
    return kept.unionByName(repeated.select(docs.columns))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows, with all their columns, such that one row of each component of fingerprints stays."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = pa.array([fingerprint(x) for x in raw_texts(batch.column(2))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes], ["k", "content", "fp"])

    with short_batches(docs.sparkSession):
        marked = cut(docs.select(F.col(f"`{key}`").alias("k"), row_code(docs).alias("content"), F.col(f"`{text}`")).mapInArrow(run, f"k {kind}, content long, fp long"))
    of = fingerprint_components(marked.select("k", "fp"), "k")
    rooted = cut(spread_join(marked, of.select("fp", "root"), "fp").select(F.col("k").alias(key), "content", "root"))
    return keep_first(docs, rooted, key)
