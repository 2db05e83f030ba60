"""Laws of the shards, and cut links."""

import zlib
from collections import Counter, defaultdict

import pytest

from rallyplan.llm import sharding as S


def check(rows, docs, shards):
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert set(sizes) <= set(range(shards)) and max(counts) - min(counts) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}
    crcs, both = Counter(r.text_crc32 for r in rows), Counter((r.text_crc32, r.shard) for r in rows)
    if None not in {t for _, t in docs}:  # a null text has the crc of an empty one
        assert all(r.cut_copies == crcs[r.text_crc32] - both[r.text_crc32, r.shard] for r in rows)


def cut_share(rows, docs):
    of = {r.doc_id: r.shard for r in rows}
    groups = defaultdict(list)
    for d, t in docs:
        groups[t].append(of[d])
    pairs = same = 0
    for x in groups.values():
        pairs += len(x) * (len(x) - 1) // 2
        same += sum(k * (k - 1) // 2 for k in Counter(x).values())
    return 1 - same / max(1, pairs)


def test_copies_stay_together(spark):
    docs = [(i, f"own {i}") for i in range(1500)] + [(10_000 + i, f"twin {i // 4} é") for i in range(600)]
    rows = S.balanced_shards(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()
    check(rows, docs, 40)
    assert cut_share(rows, docs) == 0


def test_hot_text_is_spread_and_balanced(spark):
    docs = [(i, "hot") for i in range(900)] + [(10_000 + i, f"t{i // 2}") for i in range(800)]
    rows = S.balanced_shards(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()
    check(rows, docs, 40)
    assert cut_share([r for r in rows if r.doc_id >= 10_000], docs[900:]) < 0.05


def test_groups_are_cut_only_where_they_must_be(spark):
    """Against the best that any sharding can do: 12 groups of 30 among 40 shards of 25 or 26 are cut once each; two cuts more may stay."""
    docs = [(i, f"g{i // 30}") for i in range(360)] + [(1000 + i, f"own {i}") for i in range(660)]
    rows = S.balanced_shards(spark.createDataFrame(docs, "doc_id long, text string"), 40).collect()
    check(rows, docs, 40)
    shards = defaultdict(set)
    for r in rows:
        shards[dict(docs)[r.doc_id]].add(r.shard)
    cuts = [len(x) - 1 for t, x in shards.items() if t.startswith("g")]
    assert len(cuts) == 12 and min(cuts) == 1 and sum(cuts) <= 14


@pytest.mark.parametrize("n", [0, 1, 3, 41])
def test_small_and_odd(spark, n):
    docs = ([(1, None), (2, None), (None, ""), (None, "x" * 40_000), (5, "same"), (5, "same")] * 7)[:n]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard", "3 AS g")
    check(S.balanced_shards(frame).collect(), docs, 40)
