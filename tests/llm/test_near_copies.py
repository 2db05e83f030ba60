"""The near-dedup stage against brute force."""

import random

import numpy as np

import corpus_pipeline
from rallyplan.llm import near_copies as N


def brute_roots(texts):
    """Component of each text by comparing all pairs of shingle sets."""
    sets = []
    for x in texts:
        words = (x or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both * 5 >= (len(a) + len(sets[j]) - both) * 4 > 0:
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return [root(i) for i in range(len(texts))]


def planted(pick, groups):
    words, texts = [f"w{i}" for i in range(3000)], ["", None, "one two", "ONE  two", "one two three"]
    for _ in range(groups):
        text = [pick.choice(words) for _ in range(pick.randrange(1, 400))]
        texts.append(" ".join(text))
        for _ in range(pick.randrange(0, 6)):
            other = list(text)
            for _ in range(pick.randrange(0, 1 + len(text) // 30)):
                other[pick.randrange(len(other))] = pick.choice(words)
            texts.append(" ".join(other))
    return texts


def test_stage_removes_planted_near_copies(spark):
    texts = planted(random.Random(8), 120)
    roots = brute_roots(texts)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(roots)) and len(got) < len(texts) * 2 // 3


def test_what_looks_alike_but_is_not_stays(spark):
    line = " ".join(f"x{i}" for i in range(10))
    texts = [" ".join([line] * 60 + [f"{k}y{i}" for i in range(20)]) for k in "ab"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, docs, "").count() == 2


def test_groups_with_several_components_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(N, "band_codes", lambda own: [1, 2] if len(own) else [])  # all share a band
    texts = planted(random.Random(9), 40)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    roots = {}
    for r in N.near_copies(docs).collect():
        roots.setdefault(r.root, set()).add(r.doc_id)
    want = {}
    for i, r in enumerate(brute_roots(texts)):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, roots.values())) == sorted(map(sorted, want.values()))


def test_large_bands_are_searched_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "band_codes", lambda own: [1, 2] if len(own) else [])
    monkeypatch.setattr(N, "CHUNK_ROWS", 16)
    monkeypatch.setattr(N, "TURNS", ())
    monkeypatch.setattr(N, "_neighbours", lambda members, *_: members.select("code", "root").limit(0).toDF("a", "b"))  # all is left to the search
    texts = planted(random.Random(10), 60)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in N.keep_one(docs).collect())
    assert got == sorted(set(brute_roots(texts)))


def test_radius_holds_similar_sets():
    pick = np.random.default_rng(2)
    for common in (4, 8, 20, 60, 300):
        for _ in range(300):
            own = pick.integers(0, 1 << 63, common + common // 4, dtype=np.uint64)
            cut = common + int(pick.integers(0, common // 4 + 1))
            a, b = N.fingerprint(own[:cut]), N.fingerprint(np.concatenate([own[:common], own[cut:]]))
            assert np.bitwise_count(a ^ b).sum() <= N.RADIUS


def test_sketches_hold_similar_sets():
    pick = np.random.default_rng(3)
    for common in (4, 8, 20, 60, 300, 3000):
        for _ in range(200):
            own = pick.integers(0, 1 << 63, common + common // 4, dtype=np.uint64) * np.uint64(2)
            cut = common + int(pick.integers(0, common // 4 + 1))
            a, b = np.unique(own[:cut]), np.unique(np.concatenate([own[:common], own[cut:]]))
            assert N.alike(a, b) and N.hopeful(N.sketch(a)[None], N.sketch(b)[None], np.array([len(a) + len(b)]))[0]


def test_look_alikes_are_ruled_out_by_sketches():
    """One text of 200 words with 5 words changed in each: some 0.6 alike, so that bands are shared and few pairs are compared set by set."""
    pick = random.Random(4)
    base = [f"w{pick.randrange(5000)}" for _ in range(200)]
    sets = []
    for k in range(120):
        own = list(base)
        for i in pick.sample(range(200), 5):
            own[i] = f"n{k}.{i}"
        sets.append(N.shingles(" ".join(own).encode()))
    sketches = np.array([N.sketch(x) for x in sets])
    a, b = np.triu_indices(120, 1)
    near = np.array([N.alike(sets[i], sets[j]) for i, j in zip(a, b)])
    size = np.array([len(x) for x in sets])
    hopeful = N.hopeful(sketches[a], sketches[b], size[a] + size[b])
    assert not (near & ~hopeful).any() and hopeful.mean() < 0.05


def test_large_bands_are_thinned_first(spark, monkeypatch):
    monkeypatch.setattr(N, "band_codes", lambda own: [1, 2] if len(own) else [])
    monkeypatch.setattr(N, "CHUNK_ROWS", 16)
    texts = planted(random.Random(12), 50)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == sorted(set(brute_roots(texts)))


def test_one_row_of_each_component(spark):
    text, other = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    rows = [(1, text), (1, other), (2, other), (2, text), (None, text), (3, text), (3, text), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in N.keep_one(docs).collect()), key=str) == sorted([(1, text), (1, other), (None, "alone")], key=str)
