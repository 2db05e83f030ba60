"""Permutation index: footrule distances, exact distances and recall against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyplan.llm import permutations as P, queries, vectors

QUERY = "vec_id % 100 = 0"


def brute(rows):
    """[(vec_id, embedding)] -> {query_id: [(distance, vec_id)]}, the nearest ten."""
    good = {(i, tuple(map(float, x))) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)}
    out = {}
    for i, q in good:
        if i % 100 == 0:
            out[i] = sorted((math.dist(q, x), j) for j, x in good if j != i and len(x) == len(q))[:10]
    return out


def by_query(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        own.append((r.score, r.vec_id))
        assert r.rank == len(own)
    return out


def recall(got, want):
    """Share of the true neighbours that are found; what is found has its exact distance and order."""
    for own in got.values():
        assert own == sorted(own)
    hits = sum(len({j for _, j in got.get(q, [])} & {j for _, j in own}) for q, own in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.9), ("sf0.1", 0.95)])
def test_recall_of_the_query(sf, least, spark):
    """Unit vectors in all directions, the hardest case: no cluster helps."""
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = by_query(queries.QUERIES["op13_nearest_neighbours"](spark, folder)), brute(rows)
    assert set(got) == set(want) and all(len(own) == 10 for own in got.values())
    vector = dict(rows)
    assert all(s == pytest.approx(math.dist(vector[q], vector[j]), abs=1e-12) for q, own in got.items() for s, j in own)
    assert recall(got, want) >= least


def test_clusters_copies_and_ties_in_blocks(spark, monkeypatch):
    """A third of the rows is one vector: its copies are all ranked, the smallest ids come first."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = [(int(i), [1.0] * 16 if i % 3 == 0 else (centres[i % 12] + rng.normal(size=16) / 9).tolist()) for i in rng.permutation(3000)]
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got, want = by_query(P.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.expr(QUERY))), brute([(i, np.float32(x).tolist()) for i, x in rows])
    assert all(own == [(0.0, j) for j in [k for k in range(0, 60, 3) if k != q][:10]] for q, own in got.items() if q % 3 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.95


def test_footrule_from_postings():
    rng = np.random.default_rng(1)
    x, own = rng.normal(size=(60, 5)), rng.normal(size=(100, 5))
    segment, order = P.posted(np.arange(60), x, own), P.orders(x, own)
    k = order.shape[1]
    assert k == P.NEAREST
    for i in range(0, 60, 7):
        place = {p: j for j, p in enumerate(order[i])}
        for r in range(60):
            there = {p: j for j, p in enumerate(order[r])}
            footrule = sum(abs(place.get(p, k) - there.get(p, k)) for p in place | there)
            assert footrule == k * (k + 1) - 2 * P.shared(segment, order[i])[r]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [5.0, 5.0]), (1, [1.0, 3.0]), (1, [1.0, 3.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]),
            (8, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (101, [1.0, 2.0, 2.0]), (200, [1e200, 1.0]), (201, [-1e200, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS x", "1 AS code", "2 AS query", "3 AS d", "4 AS ids", "5 AS q", "6 AS segment")
    got = P.neighbours(frame, F.expr(QUERY)).collect()
    assert sorted((r.rank, r.vec_id) for r in got if r.query_id == 100) == [(1, 101)]
    # two rows have the id 0: each is a query of its own, neither is the other's neighbour
    firsts = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in got if r.query_id == 0 and r.rank <= 2)
    assert firsts == sorted([(1, 8, 0.0), (2, 1, 1.0), (1, 1, round(math.dist((5, 5), (1, 3)), 9)), (2, 8, 5.0)])
    assert [r.score for r in got if r.query_id == 200 and r.vec_id == 201] == [2e200]
    assert P.neighbours(frame.limit(0), F.expr(QUERY)).count() == 0 and P.neighbours(frame.where("vec_id = 2"), F.expr(QUERY)).count() == 0
