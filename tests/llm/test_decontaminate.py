"""Block-max WAND and the passages against brute force."""

import random

import numpy as np
import pytest

from rallyplan.llm import common, decontaminate as D, queries


def items_and_texts(seed=2, items=150):
    pick = random.Random(seed)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(900)]
    line = lambda n: " ".join(pick.choice(common if pick.random() < 0.5 else rare) for _ in range(n))
    bench = [(i, f"{line(pick.randrange(3, 30))}.\n{line(pick.randrange(1, 12))}") for i in range(items)]
    texts = []
    for _ in range(60):
        parts = [line(pick.randrange(0, 200))]
        for _ in range(pick.randrange(0, 3)):
            words = pick.choice(bench)[1].split()
            for _ in range(pick.randrange(0, 6)):
                words[pick.randrange(len(words))] = "edit"
            parts += [" ".join(words), line(pick.randrange(0, 90))]
        texts.append(" ".join(parts))
    return bench, texts


def scores(index, terms):
    total = np.zeros(len(index.ids))
    for t in terms:
        total[index.docs[t]] += index.impact[t]
    return total


@pytest.mark.parametrize("postings", [1, 3, 64])
def test_wand_retrieves_all_above_threshold(postings, monkeypatch):
    monkeypatch.setattr(D, "POSTINGS", postings)
    bench, texts = items_and_texts()
    index = D.Index(bench)
    met = 0
    for text in texts + [t for _, t in bench]:
        numbers = np.array([index.number.get(w, 0) for w in D.folded_words(text.encode())], np.int64)
        for first in range(0, len(numbers), 50):
            terms = [t for t in np.unique(numbers[first : first + 100]).tolist() if t]
            all_ = scores(index, terms)
            got = dict(index.retrieve(terms))
            assert set(got) == set(np.flatnonzero(all_ >= D.LEAST_SCORE - 1e-9).tolist())
            assert all(abs(all_[d] - s) < 1e-9 for d, s in got.items())
            met += len(got)
    assert met > 100


def test_no_passage_is_lost():
    bench, texts = items_and_texts(5)
    index = D.Index(bench)
    for text in texts:
        words = D.folded_words(text.encode())
        numbers = np.array([index.number.get(w, 0) for w in words], np.int64)
        kept = set(index.passages(numbers))
        for i in range(0, max(1, len(words)), index.half):
            if i and i + index.half >= len(words):
                continue
            terms = [t for t in np.unique(numbers[i : i + 2 * index.half]).tolist() if t]
            if (scores(index, terms) >= D.LEAST_SCORE).any():
                assert (i, min(len(words), i + 2 * index.half)) in kept


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_in_order():
    pick = random.Random(9)
    for _ in range(200):
        a, b = ([bytes([pick.randrange(97, 101)]) for _ in range(pick.randrange(1, 80))] for _ in range(2))
        assert abs(D.in_order(a, b) - lcs(a, b) / len(a)) < 1e-12


def test_every_planted_passage_and_nothing_else(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    planted = {(r.doc_id, i) for r in docs for i, t in items if t in r.text}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op3_decontamination"](spark, d).collect()}
    assert planted and got == planted


def test_odd_rows(spark):
    item = "Where does the grey heron of the delta sleep?\nUnder the old wooden pier"
    rows = [(1, item), (2, None), (3, ""), (None, "x " * 50_000 + item.upper() + " y" * 100), (4, item.split("\n")[0]), (5, item), (5, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS score")
    items = spark.createDataFrame([(7, item), (8, item), (9, None), (10, "")], "item_id long, text string").selectExpr("*", "3 AS doc_id")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(d, i) for d in (1, None, 5, 5) for i in (7, 8)], key=str)
    clean = D.keep_clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 4]
    assert D.contaminated(docs, items.limit(0)).count() == 0 and D.contaminated(docs.limit(0), items).count() == 0
    assert D.keep_clean(docs, items.limit(0)).count() == len(rows)


def by_every_window(index, raw):
    """Items that some window of twice their words holds."""
    words, out = D.folded_words(raw), set()
    for d, (question, answer) in enumerate(index.parts):
        width = max(D.LEAST_PASSAGE, 2 * (len(question) + len(answer)))
        for i in range(len(words)):
            part = words[i : i + width]
            if scores(index, {index.number[w] for w in part if w in index.number})[d] >= D.LEAST_SCORE - 1e-9 and lcs(question, part) >= D.LEAST_QUESTION * len(question) - 1e-9 and lcs(answer, part) >= D.LEAST_ANSWER * len(answer) - 1e-9:
                out.add(index.ids[d])
                break
    return out


def test_a_long_item_doesnt_loosen_the_others():
    pick = random.Random(4)
    bench = [(0, "Which bird sleeps under the wooden pier near the river delta at night?\nThe old grey heron of the marsh")]
    bench += [(1, " ".join(f"l{pick.randrange(600)}" for _ in range(1500)))]
    index = D.Index(bench)
    words = [w.decode() for w in D.folded_words(bench[0][1].encode())]
    spread = " ".join(f"{w} " + " ".join(f"x{pick.randrange(99)}" for _ in range(40)) for w in words)
    near = "before " * 200 + " ".join(f"{w} y" for w in words) + " after" * 200
    assert index.matches(spread.encode()) == []
    assert [x[0] for x in index.matches(near.encode())] == [0] and [x[0] for x in index.matches(bench[1][1].encode())] == [1]


def test_matches_are_those_of_every_window():
    bench, texts = items_and_texts(7, 12)
    bench.append((99, " ".join(t for _, t in bench) * 3))
    index, met = D.Index(bench), 0
    for text in texts[:25]:
        got = {x[0] for x in index.matches(text.encode())}
        assert got - {99} == by_every_window(index, text.encode()) - {99}
        met += len(got)
    assert met


@pytest.mark.parametrize("kind", ["int", "string", "decimal(10,0)"])
def test_results_dont_depend_on_the_number_of_blocks(spark, monkeypatch, kind):
    bench, texts = items_and_texts(11)
    items = spark.createDataFrame([*bench, (None, bench[3][1]), (500, bench[3][1])], "item_id long, text string").selectExpr(f"CAST(item_id AS {kind}) AS item_id", "text")
    if kind == "string":
        items = items.unionByName(spark.createDataFrame([("", bench[4][1]), (None, bench[5][1])], "item_id string, text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    size = sum(len(r.text) for r in items.collect())
    results = []
    for blocks in (1, 2, 50):
        monkeypatch.setattr(D, "BLOCK_BYTES", -(-size // blocks))
        results.append(sorted((tuple(r) for r in D.contaminated(docs, items).collect()), key=str))
    assert len(results[0]) > 30 and results[0] == results[1] == results[2]


def test_few_postings_at_once_find_the_same(monkeypatch):
    bench, texts = items_and_texts(5)
    index = D.Index(bench)
    numbers = [np.array([index.number.get(w, 0) for w in D.folded_words(t.encode())], np.int64) for t in texts]
    many = [list(index.passages(x)) for x in numbers]
    monkeypatch.setattr(D, "EXPANDED", 5)
    assert [list(index.passages(x)) for x in numbers] == many and sum(map(len, many)) > 20


def test_the_clean_rows_dont_depend_on_the_number_of_blocks(spark, monkeypatch):
    """Also with null and repeated texts, a column named like the digests', and by a shuffle in place of a broadcast; a block is gone when the next one is read."""
    bench, texts = items_and_texts(11)
    items = spark.createDataFrame(bench, "item_id long, text string")
    rows = [*enumerate(texts), *((100 + i, t) for i, t in enumerate(texts[:20])), (200, None), (201, ""), (None, bench[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS item_id")
    size = sum(len(t) for _, t in bench)
    index = D.Index(bench)
    expected = sorted(((i, t) for i, t in rows if not index.matches((t or "").encode())), key=str)
    alive, most = [], []
    made, destroy = D.Block, D.Broadcast.destroy
    monkeypatch.setattr(D, "Block", lambda *x: (alive.append(x[0]), most.append(len(alive)), made(*x))[-1])
    monkeypatch.setattr(D.Broadcast, "destroy", lambda self: (alive.pop(), destroy(self))[-1])
    for blocks, few in ((1, 10), (2, 0), (9, 1_000_000)):
        alive.clear(), most.clear()
        monkeypatch.setattr(D, "BLOCK_BYTES", -(-size // blocks))
        monkeypatch.setattr(common, "FEW", few)
        clean = D.keep_clean(docs, items)
        assert clean.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == expected
        assert len(most) == blocks and max(most) == 1
        alive.clear(), most.clear()
        assert {r.doc_id for r in D.contaminated(docs, items).collect()} == {i for i, t in rows if (i, t) not in expected} and max(most) == 1
    assert 20 < len(expected) < len(rows) - 20
