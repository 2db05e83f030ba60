"""Held-out accuracy, and flattened trees against walking them."""

import numpy as np

from rallyplan.llm import quality_model as M, queries


def test_flat_trees_as_walked():
    pick = np.random.default_rng(0)
    x = pick.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = M.train(x, y)
    b = model.bins(x)
    for i in range(0, 800, 37):
        total = model.start
        for f, cut, v in zip(model.feature, model.bin, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if b[i, f[node]] > cut[node] else 1)
            total += v[node - len(f)]
        assert abs(total - model.margin(x[i : i + 1])[0]) < 1e-9
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    k = y.sum()
    return (rank[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES["op5_quality_classifier"](spark, d).toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    assert auc(both.score.to_numpy(), both.quality.to_numpy()) > 0.97
    assert (both.predicted[both.quality == 1] == 1).mean() > 0.98
    assert (both.predicted[both.quality == 0] == 0).mean() > 0.6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, ""), (3, "x" * 60_000), (3, "x" * 60_000)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in M.score_documents(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 0, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    out = M.score_documents(docs, one).collect()
    assert len(out) == 5 and {r.predicted for r in out} == {1}
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert M.score_documents(docs.limit(0), one).count() == 0


def best_split(b, y, start):
    """The first tree's root by trying every split."""
    p = 1 / (1 + np.exp(-start))
    grad, hess, best = p - y, np.full(len(y), p * (1 - p)), (1e-9, None)
    part = lambda some: grad[some].sum() ** 2 / (hess[some].sum() + M.SMOOTH)
    for j in range(b.shape[1]):
        for cut in range(M.BINS):
            left = b[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= M.LEAST_ROWS:
                gain = part(left) + part(~left) - part(left | True)
                if gain > best[0] + 1e-9:
                    best = (gain, (j, cut))
    return best[1]


def test_histograms_find_the_best_splits(monkeypatch):
    monkeypatch.setattr(M, "TREES", 1)
    for seed in range(5):
        pick = np.random.default_rng(seed)
        x = np.round(pick.normal(size=(400, 4)), 1)
        y = (x[:, seed % 4] + 0.5 * x[:, (seed + 1) % 4] + pick.normal(size=400) > 0).astype(float)
        model = M.train(x, y)
        b = model.bins(x)
        j, cut = best_split(b, y, model.start)
        assert (model.feature[0][0], model.bin[0][0]) == (j, cut)
        # each leaf holds the step that its rows ask for
        p = y.mean()
        total = model.margin_of_bins(b) - model.start
        for v in np.unique(total):
            own = total == v
            assert abs(v + M.RATE * (p - y[own]).sum() / (own.sum() * p * (1 - p) + M.SMOOTH)) < 1e-6


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    monkeypatch.setattr(M, "SAMPLE", 50)
    docs = spark.createDataFrame([(i % 7, f"word{i} again") for i in range(700)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    x, y = M.sample(docs, labels, "doc_id", "text", "quality")
    assert len(x) == len(y) == 50
