"""Quality rules by suffix-array repetition (operator 6).

The words of many texts go into one suffix array at a time: ranks by prefix
doubling, where a suffix's first rank holds its text too, so that no two texts
share a prefix and a text's end is smaller than any word. Longest common
prefixes of neighbours follow from the ranks of all levels, or from the text. An interval of the
array with common prefix l is a repeated substring of l words; at a suffix the
longest is the larger of the prefixes shared with its two neighbours, and the
union of these spans covers what the maximal repeats cover.

Verdict of the method: spans of at least ``MIN_WORDS`` words count; a text fails
if they cover more than ``MOST_COVERED`` of its words while it has ``ENOUGH``
words, or if one repeat is longer than ``LONGEST`` words.

Defined results: null and empty texts have no words and fail the base rule;
repeated rows give repeated rows; an empty table gives an empty table; other
columns don't matter; a text may be of any length. Memory grows in proportion to
one block of texts (``BLOCK`` words, or a single longer text), about 100 bytes a
word: the ranks of all levels are kept for ``LEVELS`` words at most, beyond that
the prefixes come from walking the suffixes in the order of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rallyplan.llm.common import slices

#: Words that one suffix array holds, unless one text is longer.
BLOCK = 60_000
#: Words up to which the ranks of all levels are kept.
LEVELS = 1 << 19
#: Words of a repeat that counts for the method.
MIN_WORDS = 6
MOST_COVERED = 0.3
LONGEST = 400
ENOUGH = 20
#: Base rule.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = bytes(range(9, 14)) + b" "
#: Blank for every white space of the word pattern, and nothing else changes.
BLANKS = bytes(32 if c in SPACES else c for c in range(256))
CONTINUED = bytes(range(0x80, 0xC0))


def suffix_ranks(first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the sequence and its ranks by the first 1, 2, 4, ... items (only the last of them beyond LEVELS); ``first`` are ranks by one item.

    A rank is the place of the first suffix of its group, so only groups of
    several suffixes are sorted again at the next level.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank, step = _group_starts(first[order], order, np.empty(n, np.int64), np.arange(n)), 1
    levels = [rank]
    keep = n <= LEVELS
    while step < n:
        ordered = rank[order]
        tied = np.zeros(n, bool)
        tied[1:] = ordered[1:] == ordered[:-1]
        tied[:-1] |= tied[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            break
        own = order[places]
        after = np.zeros(len(own), np.int64)
        inside = own + step < n
        after[inside] = rank[own[inside] + step] + 1
        key = rank[own] * (n + 2) + after
        by = np.argsort(key, kind="stable")
        order[places] = own[by]
        rank = _group_starts(key[by], own[by], rank.copy() if keep else rank, places)
        if keep:
            levels.append(rank)
        step *= 2
    return order, levels


def _group_starts(key: np.ndarray, items: np.ndarray, rank: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Put into rank, for items in order of key, the place of the first item with the same key."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    rank[items] = places[new][np.cumsum(new) - 1]
    return rank


def neighbour_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the array shares with the one before it."""
    n = len(order)
    shared = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    got = np.zeros(max(0, n - 1), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        got[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    shared[1:] = got
    return shared


def prefixes_by_text(first: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The same in one array: from one place of the text to the next, the prefix shared with the suffix before it in order shrinks by one at most."""
    n = len(order)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    shared = np.zeros(n, np.int64)
    word, place, before, out = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (first, rank, order, shared))
    h = 0
    for i in range(n):
        at = place[i]
        if not at:
            h = 0
            continue
        j = before[at - 1]
        most = n - max(i, j)
        while h < most and word[i + h] == word[j + h]:
            h += 1
        out[at] = h
        h -= h > 0
    return shared


def longest_repeats(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text and each of its words: length of the longest repeat that starts there."""
    sizes = np.array([len(x) for x in texts])
    total = int(sizes.sum()) + len(texts)
    if not sizes.sum():
        return [np.zeros(0, np.int64) for _ in texts]
    numbers: dict[bytes, int] = {}
    words = np.empty(total, np.int64)
    own = np.repeat(np.arange(len(texts)), sizes + 1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    for i, x in enumerate(texts):
        words[starts[i] : starts[i + 1] - 1] = [numbers.setdefault(w, len(numbers) + 1) for w in x]
        words[starts[i + 1] - 1] = 0
    _, first = np.unique(own * (len(numbers) + 1) + words, return_inverse=True)
    order, levels = suffix_ranks(first.astype(np.int64))
    shared = neighbour_prefixes(order, levels) if total <= LEVELS else prefixes_by_text(first, order)
    longest = np.empty(total, np.int64)
    longest[order] = np.maximum(shared, np.concatenate((shared[1:], [0])))
    return [longest[starts[i] : starts[i + 1] - 1] for i in range(len(texts))]


def covered(longest: np.ndarray, least: int, width: int | None = None) -> int:
    """Words in the union of the spans that start where ``longest`` >= least; spans have that length, or ``width``."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    if not len(at):
        return 0
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(n, at + (width or longest[at])), -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    chars = sum(map(len, words))
    if not raw.isascii():
        chars -= len(raw) - len(raw.translate(None, CONTINUED))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    duplicates = 0
    if b"\n" in raw:
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line.translate(None, SPACES):
                if line in seen:
                    duplicates += 1
                seen.add(line)
    return chars, symbols, duplicates


def judge(raws: list[bytes]) -> Iterator[tuple]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words, longest_repeat by text."""
    block: list[tuple[bytes, list[bytes]]] = []
    held = 0
    for raw in raws:
        words = raw.translate(BLANKS).split(b" ")
        words = [w for w in words if w]
        block.append((raw, words))
        held += len(words)
        if held >= BLOCK:
            yield from _judge_block(block)
            block, held = [], 0
    yield from _judge_block(block)


def _judge_block(block: list[tuple[bytes, list[bytes]]]) -> Iterator[tuple]:
    repeats = longest_repeats([w for _, w in block])
    for (raw, words), longest in zip(block, repeats, strict=True):
        n = len(words)
        chars, symbols, duplicates = base_counts(raw, words)
        repeated = covered(longest, WINDOW, WINDOW)
        failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
        spans, most = covered(longest, MIN_WORDS), int(longest.max(initial=0))
        bad = (n >= ENOUGH and spans > MOST_COVERED * n) or most > LONGEST
        yield n, chars, symbols, duplicates, repeated, failed, not failed and not bad, spans, most


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the judgement of every whole text."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "longest_repeat"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2

    def run(batches):
        for batch in slices(batches, 512):
            raws = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = list(zip(*judge(raws), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, *names])

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in zip(names, types, strict=True))
    return docs.select(key, text).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose whole text is kept."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, 512):
            raws = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            good = pa.array([x[6] for x in judge(raws)], pa.bool_())
            yield batch.filter(good)

    return docs.mapInArrow(run, docs.schema)
