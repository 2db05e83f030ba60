"""Suffix-array repetition against brute force."""

import random
import re

import pytest

from rallyplan.llm import repetition as R


def brute_longest(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    longest, n = brute_longest(words), len(words)
    windows = [tuple(words[i : i + 8]) for i in range(n - 7)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    spans = {i + k for i, x in enumerate(longest) if x >= R.MIN_WORDS for k in range(x)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = n < 20 or 100 * len(repeated) > 30 * n
    bad = (n >= R.ENOUGH and len(spans) > R.MOST_COVERED * n) or max(longest, default=0) > R.LONGEST
    return n, sum(map(len, words)), len(R.SYMBOLS.findall(text)), dup, len(repeated), failed, not failed and not bad, len(spans), max(longest, default=0)


def cases():
    pick = random.Random(5)
    out = ["", " \n\t", "one", "a b " * 40, "x" * 5000, "#*$ é ü\x0b\x0c日本 \x1c \x85", "l1 a\nl1 a\n\n \nl1 a", "a\r\na\r\n"]
    for _ in range(60):
        words = [pick.choice("ab cd éé f# g h".split()) for _ in range(pick.randrange(1, 90))]
        part = words[: pick.randrange(1, 30)]
        out.append(pick.choice([" ", "\n", "  "]).join(words + part * pick.randrange(0, 3)))
    return out


def test_repeats_of_a_block_are_those_of_each_text():
    texts = [x.encode().split() for x in cases()]
    for words, got in zip(texts, R.longest_repeats(texts), strict=True):
        assert got.tolist() == brute_longest(words)


def test_judgement_by_brute_force(spark):
    rows = [(i, x) for i, x in enumerate(cases())] + [(100, None), (None, "a b"), (7, "a\r\na\r\n"), (7, "a\r\na\r\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS n_words")
    got = sorted((tuple(r) for r in R.quality(docs).collect()), key=str)
    assert got == sorted(((i, *brute(x or "")) for i, x in rows), key=str)
    assert R.quality(docs.limit(0)).count() == 0
    kept = R.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(x[7] for x in got)


@pytest.mark.parametrize("block", [1, 50, 10**6])
def test_blocks_change_nothing(block, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", block)
    assert list(R.judge([x.encode() for x in cases()])) == [brute(x) for x in cases()]
