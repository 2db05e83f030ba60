"""Benchmark decontamination by BM25 with block-max WAND (operator 3).

Index: the words of every test item with their BM25 impacts, each divided by the
item's score for its own words, so that a passage's score is the share of the
item's BM25 mass that the passage holds. Document frequencies, the number of items
and their mean and largest length are counted once over all items. Postings are
sorted by item and cut into blocks with their largest impact.

Query: every text is cut into passages of twice the longest item's words (64 at
least), each half over the next, so that every item fits into one. Block-max WAND
over a passage's distinct words retrieves all items from ``LEAST_SCORE`` on. It is
spared for passages that can't reach that for any item (the MaxScore split: words
of many items are set aside as long as no item has more than ``IDLE`` of its mass
in them; the distinct other words have to bring an item the rest). This looks at
``EXPANDED`` postings at once, however long the text is.

Check: every retrieved item is looked for in windows of its own width, twice its
words (``LEAST_PASSAGE`` at least), however wide the passage is; one starts at each
of its words in the passage. An item is question and answer: its last line, or else
its last sentence, or else its last third of words, is the answer. The window has to
hold ``LEAST_SCORE`` of the item's mass, and both parts in order (longest common
subsequence) to ``LEAST_QUESTION`` and ``LEAST_ANSWER`` of their words.

Items are held by blocks of at most ``BLOCK_BYTES`` of text, with a pass over the
documents for each. A block is broadcast, and its result is written before the next
block is read, so that the driver and a task hold one block at a time, however many
items there are; the results don't depend on the number of blocks.

Defined results: null and empty texts match nothing, null and empty items aren't
items; equal items each match; ids may be of any type, null ones are carried along;
a text of any length takes memory in proportion to its words; repeated rows give
repeated rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rallyplan.llm.common import cut, folded_words, raw_texts, slices, unmatched

K1, B = 1.2, 0.75
#: Share of an item's BM25 mass from which on it is retrieved.
LEAST_SCORE = 0.5
LEAST_QUESTION, LEAST_ANSWER = 0.7, 0.6
#: Postings in a block.
POSTINGS = 64
#: Words of more items than that may be left aside at first, as long as no item's mass in them exceeds IDLE.
RARE, IDLE = 4, 0.35
LEAST_PASSAGE = 64
BLOCK_BYTES = 32 << 20
#: Postings that are looked at in one step.
EXPANDED = 1 << 20


@dataclass(frozen=True)
class Statistics:
    """Over all items: how many, their mean and largest number of words, and in how many each word stands."""

    items: int
    mean: float
    largest: int
    held: dict[bytes, int]


def statistics(items: list[tuple[object, str]]) -> Statistics:
    """Of a list of items."""
    own = [w for w in (folded_words(t.encode()) for _, t in items if t) if w]
    return Statistics(len(own), sum(map(len, own)) / max(1, len(own)), max(map(len, own), default=0), Counter(w for words in own for w in set(words)))


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of both."""
    for parts in (text.strip().split("\n"), re.split(r"(?<=[.!?])\s+", text.strip())):
        words = [folded_words(x.encode()) for x in parts]
        words = [w for w in words if w]
        if len(words) > 1:
            return [w for x in words[:-1] for w in x], words[-1]
    words = folded_words(text.encode())
    cut = len(words) - len(words) // 3
    return words[:cut], words[cut:]


def in_order(part: list[bytes], passage: list[bytes]) -> float:
    """Share of part's words in its longest common subsequence with passage."""
    if not part:
        return 1.0
    masks: dict[bytes, int] = {}
    for i, w in enumerate(part):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(part)) - 1
    row = full
    for w in passage:
        if (m := masks.get(w)) is not None:
            met = row & m
            row = ((row + met) | (row - met)) & full
    return (len(part) - row.bit_count()) / len(part)


class Index:
    """BM25 impacts of the items' words, relative to each item's own score."""

    def __init__(self, items: list[tuple[object, str]], of_all: Statistics | None = None):
        of_all = of_all or statistics(items)
        own = [(i, t, Counter(folded_words(t.encode()))) for i, t in items if t]
        own = [x for x in own if x[2]]
        self.ids = [i for i, _, _ in own]
        self.parts = [question_and_answer(t) for _, t, _ in own]
        lengths = [sum(c.values()) for _, _, c in own]
        self.half = max(LEAST_PASSAGE // 2, of_all.largest)
        self.widths = [max(LEAST_PASSAGE, 2 * x) for x in lengths]
        held, n, mean = of_all.held, of_all.items, of_all.mean
        impacts: dict[bytes, list[tuple[int, float]]] = {w: [] for w in sorted({w for _, _, c in own for w in c})}
        for d, (_, _, c) in enumerate(own):
            mass = {w: math.log(1 + (n - held[w] + 0.5) / (held[w] + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * lengths[d] / mean)) for w, k in c.items()}
            total = sum(mass.values())
            for w, x in mass.items():
                impacts[w].append((d, x / total))
        self.number = {w: t + 1 for t, w in enumerate(impacts)}  # 0: any other word
        self.terms = [np.array(sorted(self.number[w] for w in c), np.int64) for _, _, c in own]
        self.docs = [np.zeros(0, np.int64), *(np.array([d for d, _ in p]) for p in impacts.values())]
        self.impact = [np.zeros(0), *(np.array([x for _, x in p]) for p in impacts.values())]
        self.most = np.array([p.max(initial=0) for p in self.impact])
        self.block_most = [np.array([x[i : i + POSTINGS].max() for i in range(0, len(x), POSTINGS)]) for x in self.impact]
        # words left aside: in many items, as long as no item has more than IDLE in them
        self.idle = np.zeros(len(own))
        aside = np.zeros(len(self.docs), bool)
        for t in sorted(range(1, len(self.docs)), key=lambda t: (-len(self.docs[t]), t)):
            after = self.idle[self.docs[t]] + self.impact[t]
            if len(self.docs[t]) > RARE and after.max() <= IDLE:
                self.idle[self.docs[t]], aside[t] = after, True
        self.needed = LEAST_SCORE - self.idle - 1e-9
        # the other words' postings, one after another
        self.count = np.where(aside, 0, [len(x) for x in self.docs])
        self.start = np.cumsum(self.count) - self.count
        kept = [t for t in range(len(self.docs)) if self.count[t]]
        self.rare_docs = np.concatenate([np.zeros(0, np.int64), *(self.docs[t] for t in kept)])
        self.rare_impact = np.concatenate([np.zeros(0), *(self.impact[t] for t in kept)])

    def passages(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first, end) of the passages that may reach the threshold for some item: the words that aren't set aside give it enough."""
        half, width = self.half, len(self.docs)
        halves, n = -(-len(numbers) // half), len(self.ids)
        # the distinct words of each half, those set aside left out
        places = np.flatnonzero(self.count[numbers])
        if not len(places):
            return
        pairs = np.unique(places // half * width + numbers[places])
        place, terms = pairs // width, pairs % width
        count = self.count[terms]
        ends = np.cumsum(count)
        able = np.zeros(halves + 1, bool)
        low = 0
        while low < halves:
            # as many halves as EXPANDED postings allow, two at least: a passage is two halves
            first = np.searchsorted(place, low)
            fits = np.searchsorted(ends, (ends[first - 1] if first else 0) + EXPANDED, side="right")
            high = max(low + 2, int(place[fits]) if fits < len(place) else halves)
            last = np.searchsorted(place, high)
            if last > first:
                of = count[first:last]
                at = np.repeat(self.start[terms[first:last]] - (np.cumsum(of) - of), of) + np.arange(of.sum())
                keys, where = np.unique(np.repeat(place[first:last], of) * n + self.rare_docs[at], return_inverse=True)
                sums = np.bincount(where, self.rare_impact[at])
                # with what the next half holds of the same item
                after = np.searchsorted(keys, keys + n)
                inside = np.minimum(after, len(keys) - 1)
                both = sums + np.where(keys[inside] == keys + n, sums[inside], 0.0)
                enough = keys[both >= self.needed[keys % n]]
                able[enough // n] = True
                alone = keys[sums >= self.needed[keys % n]]  # the second half of a passage alone
                able[np.maximum(alone // n - 1, 0)] = True
            if high >= halves:
                break
            low = high - 1
        for i in np.flatnonzero(able[:halves]).tolist():
            if i and i == halves - 1:
                continue  # the last half is all in the passage before it
            yield i * half, min(len(numbers), (i + 2) * half)

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with score >= LEAST_SCORE for the distinct terms: block-max WAND."""
        least = LEAST_SCORE - 1e-9
        # a cursor a term: item, place, term, then views on its items, impacts, largest impacts by block, and its largest one
        cursors = []
        for t in terms:
            items = memoryview(self.docs[t])
            cursors.append([items[0], 0, t, items, memoryview(self.impact[t]), memoryview(self.block_most[t]), float(self.most[t])])
        out = []
        cursors.sort()
        while cursors:
            # pivot: the first cursor at which the sum of the terms' largest impacts reaches the threshold
            total, pivot = 0.0, -1
            for i, x in enumerate(cursors):
                total += x[6]
                if total >= least:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            # the same sum by the blocks that the item would lie in
            total, last, held = 0.0, None, []
            for x in cursors[: pivot + 1]:
                items = x[3]
                at = bisect_left(items, item, x[1])
                if at < len(items):
                    block = at // POSTINGS
                    total += x[5][block]
                    edge = items[min(len(items), (block + 1) * POSTINGS) - 1]
                    last = edge if last is None else min(last, edge)
                    if items[at] == item:
                        held.append(x[4][at])
            if total >= least:
                score = sum(held)
                if score >= least:
                    out.append((item, score))
                beyond = item + 1
            else:
                # no item up to the nearest block end can reach it, nor before the next cursor's item
                beyond = max(item + 1, last + 1 if last is not None else 0)
                if pivot + 1 < len(cursors):
                    beyond = max(item + 1, min(beyond, cursors[pivot + 1][0]))
            moved = []
            for x in cursors[: pivot + 1]:  # all stand before ``beyond``
                x[1] = bisect_left(x[3], beyond, x[1])
                if x[1] < len(x[3]):
                    x[0] = x[3][x[1]]
                    moved.append(x)
            cursors[: pivot + 1] = moved
            cursors.sort()
        return out

    def windows(self, d: int, numbers: np.ndarray, places: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(score, places of the item's words) of the item's windows with score >= LEAST_SCORE that start at one of the places.

        places: those of the item's words, in order. A window whose words all stand in the one before it is left out.
        """
        terms = numbers[places]
        mass = np.array([self.impact[t][np.searchsorted(self.docs[t], d)] for t in self.terms[d].tolist()])[np.searchsorted(self.terms[d], terms)]
        ends = np.searchsorted(places, places + self.widths[d])
        sums = np.concatenate(([0.0], np.cumsum(mass)))
        # a word that stands several times is counted each time at first: a bound
        able = (np.diff(ends, prepend=0) > 0) & (sums[ends] - sums[:-1] >= LEAST_SCORE - 1e-6)
        for i in np.flatnonzero(able).tolist():
            _, first = np.unique(terms[i : ends[i]], return_index=True)
            score = float(mass[i : ends[i]][first].sum())
            if score >= LEAST_SCORE - 1e-9:
                yield score, places[i : ends[i]]

    def matches(self, raw: bytes) -> list[tuple]:
        """(item_id, score, question overlap, answer overlap, first word of the window), the best window of each verified item."""
        words = folded_words(raw)
        if not words or not self.ids:
            return []
        numbers = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        best: dict[int, tuple] = {}
        for first, end in self.passages(numbers):
            order = np.argsort(numbers[first:end], kind="stable")
            ranked = numbers[first:end][order]
            terms = np.unique(ranked)
            for d, _ in self.retrieve(terms[terms > 0].tolist()):
                question, answer = self.parts[d]
                low, high = np.searchsorted(ranked, self.terms[d]), np.searchsorted(ranked, self.terms[d], side="right")
                places = first + np.sort(np.concatenate([order[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]))
                for score, at in self.windows(d, numbers, places):
                    own = [words[i] for i in at.tolist()]
                    q, a = in_order(question, own), in_order(answer, own)
                    if q >= LEAST_QUESTION and a >= LEAST_ANSWER:
                        best[d] = max(best.get(d, (0.0, 0.0, 0.0, 0)), (round(min(score, 1.0), 6), round(q, 6), round(a, 6), -int(at[0])))
        return [(self.ids[d], *x[:3], -x[3]) for d, x in sorted(best.items())]


_built: dict[str, Index] = {}


@dataclass(frozen=True)
class Block:
    """Some of the items with the statistics of their words, broadcast: neither the driver nor a plan holds them.

    Rows of ``value`` are (id, text); ids are told by place. The size is bounded by ``BLOCK_BYTES``.
    """

    name: str
    value: Broadcast

    @property
    def index(self) -> Index:
        """A worker process builds it once and holds one."""
        if self.name not in _built:
            _built.clear()
            items, of_all = self.value.value
            _built[self.name] = Index([(i, t) for i, (_, t) in enumerate(items)], of_all)
        return _built[self.name]

    def ids(self, kind: pa.DataType) -> pa.Array:
        """Of the items, by place."""
        return pa.array([i for i, _ in self.value.value[0]], kind)


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[Block, bool]]:
    """The items by blocks of bounded size, each made when it is asked for; and whether it is the last one."""
    some = items.select(F.col(f"`{key}`").alias("i"), F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull())
    blocks = -(-(some.agg(F.sum(F.octet_length("t")).alias("n")).first().n or 0) // BLOCK_BYTES)
    if not blocks:
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [folded_words(x) for x in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.binary()))], ["b", "n", "words"])

    some = some.withColumn("b", F.pmod(F.xxhash64("t"), F.lit(blocks)))
    told = cut(some.select("b", "t").mapInArrow(run, "b long, n long, words array<binary>").where("n > 0"))
    total = told.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("largest")).first()
    if not total["items"]:
        return
    words = told.select("b", F.explode("words").alias("w"))
    held = cut(words.groupBy("w").agg(F.count("*").alias("n")))
    for b in range(blocks):
        own = held.join(words.where(F.col("b") == b).select("w").distinct(), "w")
        of_all = Statistics(total["items"], float(total["mean"]), total["largest"], {bytes(r.w): r.n for r in own.collect()})  # the words of a block
        rows = sorted(((r.i, r.t) for r in some.where(F.col("b") == b).collect()), key=lambda x: (x[1], x[0] is None, str(x[0])))
        yield Block(uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast((rows, of_all))), b == blocks - 1


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_id, score, question_overlap, answer_overlap, passage_word): a row for each document and item that it holds."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType
    arrow_kind = to_arrow_type(item_kind)
    schema = f"`{key}` {kind}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double, passage_word long"
    found = [docs.sparkSession.createDataFrame([], schema)]
    for block, last in item_blocks(items, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index, ids = block.index, block.ids(arrow_kind)
            for batch in slices(batches):
                rows, out = [], []
                for i, raw in enumerate(raw_texts(batch.column(1))):
                    for x in index.matches(raw):
                        rows.append(i)
                        out.append(x)
                if rows:
                    item, *rest = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), ids.take(pa.array(item)), *map(pa.array, rest)], [key, "item_id", "score", "question_overlap", "answer_overlap", "passage_word"])

        rows = docs.select(key, text).mapInArrow(run, schema)
        if not last:
            rows = cut(rows)
            block.value.destroy()
        found.append(rows)
    return reduce(DataFrame.unionByName, found[1:] or found)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no item.

    Digests of the texts that hold an item of a block are written, and their rows go by an
    anti join before the next block; the last block is looked for in the pass that returns the rows.
    """
    at = docs.columns.index(text)
    for block, last in item_blocks(items, item_key, item_text):
        if last:

            def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
                index = block.index
                for batch in slices(batches):
                    yield batch.filter(pa.array([not index.matches(x) for x in raw_texts(batch.column(at))], pa.bool_()))

            return docs.mapInArrow(keep, docs.schema)

        def held(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            index = block.index
            for batch in slices(batches):
                digests = {sha256(x).hexdigest() for x in raw_texts(batch.column(0)) if index.matches(x)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(digests), pa.string())], ["digest"])

        digests = cut(docs.select(text).mapInArrow(held, "digest string").distinct())
        block.value.destroy()
        docs = unmatched(docs, digests, lambda rows, few: F.sha2(F.encode(rows[f"`{text}`"], "UTF-8"), 256) == few["digest"])
    return docs
