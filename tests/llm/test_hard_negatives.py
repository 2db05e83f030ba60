"""Hard negatives: against all scores by brute force, and the bounds of the approximations."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rallyplan.llm import hard_negatives as H, queries, vectors

ANCHOR = "vec_id % 100 = 0"


def brute(rows, positives=H.POSITIVES, negatives=H.NEGATIVES):
    """[(vec_id, embedding, label)] -> result rows, by all scores in Python's whole numbers."""
    good = []
    for i, x, label in rows:
        x = None if x is None else list(x)
        if None in (i, x, label) or not len(x) or any(c is None or not np.isfinite(c) or not np.isfinite(c * H.SCALE) for c in x):
            continue
        row = (i, label, tuple(int(np.floor(c * H.SCALE)) for c in x))
        if row not in good:
            good.append(row)
    out = []
    for i, label, x in good:
        if i % 100:
            continue
        scores = [(-min(H.MOST, max(H.LEAST, sum(a * b for a, b in zip(x, y)))), j, other == label) for j, other, y in good if j != i and len(y) == len(x)]
        scores.sort()
        for p, j, _ in [s for s in scores if s[2]][:positives]:
            inside = [(s, k) for s, k, same in scores if not same and 80 * -p <= 100 * -s <= 100 * -p]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(frame, anchor=ANCHOR):
    return sorted(map(tuple, H.hard_negatives(frame, F.expr(anchor)).collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], label) for i, x, label in rows], "vec_id long, embedding array<double>, label int")


def test_query_against_all_scores(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_hard_negatives"](spark, sf).collect())) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_close_labels_copies_and_ties(spark, seed):
    """Small whole components, so that many scores are equal; a third of the rows is one vector."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), ((1, 2, 0, 1) if i % 3 == 0 else rng.integers(-2, 3, 4)) / np.array(256.0), int(rng.integers(0, 3))) for i in rng.permutation(1200)]
    assert found(frame(spark, rows)) == brute(rows)


def test_few_cells_and_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8) + (i % 4) * 0.5, i % 4) for i in range(1500)]
    want = brute(rows)
    assert found(frame(spark, rows)) == want
    for name, value in (("CELLS", 3), ("ROWS", 50), ("ANCHORS", 4), ("HELD", 20), ("SAMPLE", 10)):
        monkeypatch.setattr(H, name, value)
    monkeypatch.setattr(vectors, "BLOCK", 6)
    assert found(frame(spark, rows)) == want


def test_only_candidates_are_scored(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16), i % 5) for i in range(4000)]
    seen, own = [], H.exact
    monkeypatch.setattr(H, "exact", lambda c, *rest: (seen.append(c.count()), own(c, *rest))[1])
    assert found(frame(spark, rows)) == brute(rows)
    assert len(seen) == 2 and seen[0] < 40 * 10 and seen[1] < 40 * 60  # of 40 * 800 and 40 * 3200 scores


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1, 2], 1), (0, [1, 2], 1), (0, [2, 1], 2), (1, [1, 1], 1), (2, [1, 1.5], 2), (3, [0, 0], 1), (4, None, 1), (5, [], 1), (6, [nan, 1], 1), (7, [inf, 1], 2), (8, [None, 1], 1), (9, [1, 1], None), (None, [1, 1], 1),
        (100, [1, 2, 3], 1), (101, [1, 2, 2], 1), (102, [1, 2, 1], 3), (200, [1e300, 1e300], 1), (201, [1e300, 1], 1), (202, [9e299, 1], 2), (203, [1e308, 1], 2), (300, [-1, -1], 9),
    ]
    clash = frame(spark, rows).selectExpr("*", "'x' AS x", "1 AS code", "2 AS same", "3 AS anchor", "4 AS cells", "5 AS a", "6 AS k", "7 AS score")
    assert found(clash) == brute(rows)
    assert found(clash.limit(0)) == [] and found(clash.where("vec_id = 3")) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 40), st.floats(1e-3, 1e9), st.integers(0, 10**6))
def test_bounds_hold(d, n, scale, seed):
    rng = np.random.default_rng(seed)
    x, sample, a = (np.floor(rng.standard_cauchy((k, d)) * scale) for k in (n, 30, 5))
    of = H.limits(sample, x.min(axis=0), x.max(axis=0))
    c = H.cells(x, of)
    low, high = of.low[np.arange(d), c], of.high[np.arange(d), c]
    assert (low <= x).all() and (x <= high).all()
    batch = H.Batch(*[np.arange(n)] * 3, low / 2 + high / 2, high / 2 - low / 2, float(np.abs([low, high]).max()))
    low, high = H.bounds(batch, a)
    exact = [[min(H.MOST, max(H.LEAST, sum(int(u) * int(v) for u, v in zip(p, q)))) for q in a] for p in x]
    assert all(low[i, j] <= exact[i][j] <= high[i, j] for i in range(n) for j in range(5))
