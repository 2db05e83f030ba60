"""SimHash near-duplicates against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

from rallyplan.llm import queries, simhash as S


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """[(doc_id, fp)] -> component by breadth first."""
    codes = sorted({f for _, f in rows})
    a = np.array(codes, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    label = [-1] * len(codes)
    for i in range(len(codes)):
        if label[i] < 0:
            todo = [i]
            label[i] = i
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if label[j] < 0:
                        label[j] = i
                        todo.append(int(j))
    group = dict(zip(codes, label, strict=True))
    least = {}
    for d, f in rows:
        if d is not None:
            least[group[f]] = min(least.get(group[f], d), d)
    return {f: least.get(group[f]) for f in codes}


def test_fingerprint():
    pick = random.Random(1)
    texts = ["", " ", "One", "one  two", "ONE two\nthree", "É é\x0b a", "x" * 100_000, *(" ".join(pick.choice(["Aa", "b", "éc", "d\n"]) for _ in range(k)) for k in range(60))]
    for x in texts:
        assert S.fingerprint(x.encode()) % (1 << 64) == brute_fingerprint(x)


def test_index_finds_every_link():
    pick = np.random.default_rng(3)
    for size, spread in ((2, 3), (9, 3), (300, 5), (3000, 6), (900, 60)):
        base = pick.integers(0, 1 << 63, 4, dtype=np.uint64)
        codes = base[pick.integers(0, 4, size)]
        for _ in range(spread):
            codes = codes ^ (np.uint64(1) << pick.integers(0, 24 if spread < 10 else 64, size).astype(np.uint64))
        codes = np.unique(codes)
        forest = S.Forest(len(codes))
        pairs = S.linked_pairs(codes)
        for a, b in pairs:
            assert bin(int(codes[a]) ^ int(codes[b])).count("1") <= 2
            assert forest.link(a, b)
        roots = forest.roots()
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
        a, b = np.nonzero(near)
        assert (roots[a] == roots[b]).all()
        assert len(pairs) < len(codes)


def test_gray_rank():
    assert S.gray_code(np.arange(8, dtype=np.uint64)[:, None])[:, 0].tolist() == [0, 1, 3, 2, 6, 7, 5, 4]
    codes = np.random.default_rng(1).integers(0, 1 << 63, (500, 2), dtype=np.uint64) << np.uint64(1)
    assert (S.gray_code(S.gray_rank(codes)) == codes).all()
    numbers = [(int(a) << 64) + int(b) for a, b in S.gray_rank(codes)]
    assert all(n ^ n >> 1 == (int(a) << 64) + int(b) for n, (a, b) in zip(numbers, codes, strict=True))


def test_components_of_a_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, n)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def rows_of_cases():
    pick = random.Random(4)
    rows, words = [], [f"w{i}" for i in range(400)]
    for i in range(40):
        text = [pick.choice(words) for _ in range(pick.randrange(0, 300))]
        rows.append((10 * i + 9, " ".join(text)))
        for k in range(pick.randrange(0, 5)):
            other = list(text)
            if other and k:
                other[pick.randrange(len(other))] = "new"
            rows.append((10 * i + 8 - k, " ".join(other)))
    return [*rows, (5000, None), (5001, ""), (5002, " \n"), (None, "alone by itself in the table"), (None, rows[0][1]), (None, rows[0][1]), (5003, "twice the same row"), (5003, "twice the same row")]


def test_whole_operator_by_brute_force(spark):
    rows = rows_of_cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "2 AS component_id")
    marks = [(d, brute_fingerprint(x)) for d, x in rows]
    of = brute_components(marks)
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted(((d, f"{f:016x}", of[f]) for d, f in marks), key=str)
    assert S.near_duplicates(docs.limit(0)).count() == 0
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted((of[f] for f in {of[f]: f for _, f in marks}.values()), key=str)
    assert S.keep_one(docs.limit(0)).count() == 0


def test_every_component_keeps_one_row_whatever_ids_it_shares(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c + " " + b), (None, d), (None, d), (8, d), (9, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in S.keep_one(docs).collect()]
    assert sorted(x for x in got if x[0] != 9) == sorted([(1, a), (5, b), (7, c), (7, c + " " + b), (8, d)])
    assert len([x for x in got if x[0] == 9]) == 1


def test_ranges_and_full_ranges(spark, monkeypatch):
    """All links are found by the indexes of ranges of Gray rank, also where ranges are dealt further."""
    pick = np.random.default_rng(5)
    codes = np.unique(np.concatenate([pick.integers(0, 1 << 63, 3000, dtype=np.uint64), np.uint64(1 << 62) ^ (np.uint64(1) << pick.integers(0, 30, 2000, dtype=np.uint64)) ^ (np.uint64(1) << pick.integers(0, 64, 2000, dtype=np.uint64))]))
    codes = np.unique(np.concatenate([codes, codes[::3] ^ (np.uint64(1) << pick.integers(0, 64, len(codes[::3]), dtype=np.uint64))]))
    marks = [(i, int(c)) for i, c in enumerate(codes)]
    of = brute_components(marks)
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    for group, most in ((4096, 1 << 18), (64, 1 << 18), (64, 200), (16, 20)):
        monkeypatch.setattr(S, "GROUP", group)
        monkeypatch.setattr(S, "MOST", most)
        placed = S.in_ranges(frame, len(codes))
        sizes = [r["count"] for r in placed.groupBy("t", "k").count().collect()]
        assert max(sizes) > S.FANOUT and (group > 64 or len(sizes) > 100)
        edges = S.links(frame)
        pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in edges.collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
        at = {int(c): i for i, c in enumerate(codes)}
        forest = S.Forest(len(codes))
        for a, b in pairs:
            forest.link(at[a], at[b])
        roots = forest.roots().tolist()
        assert [of[int(codes[r])] for r in roots] == [of[int(c)] for c in codes]
        assert len(set(roots)) == len(set(of.values()))


def test_pairs_go_down_only_where_they_may_be_near():
    """The index looks at a small part of all pairs, and the links come out of it."""
    pick = np.random.default_rng(6)
    codes = np.unique(pick.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    codes = np.unique(np.concatenate([codes, codes[:500] ^ np.uint64(1 << 40)]))
    seen = 0
    roots = np.arange(len(codes))
    rank = S.gray_rank(codes[:, None])
    index = S.GrayIndex(codes[np.argsort(rank[:, 0]), None])
    for a, b in index.near(2, lambda: roots):
        seen += len(a)
    assert 500 <= seen < 600


def test_dense_groups_are_expanded_in_little_memory():
    """The pairs that the index looks at in one step are few, however dense a group is."""
    pick = np.random.default_rng(7)
    bits = np.uint64(1) << pick.integers(0, 64, (3, 20_000), dtype=np.uint64)
    codes = np.unique(np.uint64(1 << 62) ^ bits[0] ^ bits[1] ^ bits[2])
    tracemalloc.start()
    pairs = S.linked_pairs(codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(pairs) == len(codes) - 1
    assert most < 30e6


def test_texts_come_in_short_batches(spark, monkeypatch):
    """The pass over the texts hands Python a bounded number of rows and bytes at once; the session's settings stay."""
    from rallyplan.llm.common import SHORT

    def sizes(docs, key, text):
        def run(batches):
            for b in batches:
                n, size = b.num_rows, pa.compute.sum(pa.compute.binary_length(b.column(1))).as_py()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n << 40 | size] * n, pa.int64())], ["doc_id", "fp"])

        return docs.select(key, text).mapInArrow(run, "doc_id long, fp long")

    monkeypatch.setattr(S, "fingerprints", sizes)
    before = {k: spark.conf.get(k) for k in SHORT}
    for rows, length in ((5000, 10), (200, 200_000)):
        docs = spark.range(0, rows, 1, 1).selectExpr("id AS doc_id", f"repeat('x', {length}) AS text")
        got = [int(r.fingerprint, 16) for r in S.near_duplicates(docs).collect()]
        assert len(got) == rows
        assert max(x >> 40 for x in got) <= 512
        assert max(x & (1 << 40) - 1 for x in got) <= 4 * 2**20 + length
    assert {k: spark.conf.get(k) for k in SHORT} == before


def test_sample_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    marks = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    of = brute_components(marks)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op10_simhash_near_dedup"](spark, d).collect()}
    assert got == {d: (f"{f:016x}", of[f]) for d, f in marks}
