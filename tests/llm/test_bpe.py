"""Automaton against the explicit gadgets; codec and counts against the tokenizers library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rallyplan.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
CASES = [
    "", " ", "\n\n  \t", "a", "Hello world", "don't we'll I'd", "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftex", "éàüß ñ ç", "日本語 テキスト", "🙂👍🏽 mixed",
    "x" * 3000, " " * 500 + "x", "1234567890" * 300, "\x1c\x1d\x85\xa0  end", "՘࢏\U00010940 rare", "the the the", "\r\n\r\n!!??", "�\x00\x7f", "ábc",
]


def explicit(merges):
    """Every state and arc written out: state -> {label: state}."""
    arcs = {0: {i: 0 for i in range(4)}}
    number = {bytes([i]): i for i in range(4)}
    labels = [bytes([i]) for i in range(4)]
    entered = {i: 0 for i in range(4)}
    for u, v in merges:
        a, b, w = number[u], number[v], len(labels)
        labels.append(u + v)
        number[u + v] = w
        old = entered[a]
        target = arcs[old].get(b)
        new = max(arcs) + 1
        arcs[new] = {k: x for k, x in arcs[old].items() if k != b}
        entered[a] = new
        for state in arcs.values():
            if a in state:
                state[a] = new
        entered[w] = target
        for state in arcs.values():
            if a in state:
                state[w] = target
    return labels, entered, arcs


@pytest.mark.parametrize("seed", range(30))
def test_paths_are_the_tokenizations(seed):
    pick = random.Random(seed)
    known, merges = [bytes([i]) for i in range(4)], []
    while len(merges) < 12:
        u, v = pick.choice(known), pick.choice(known)
        so_far = {p: i for i, p in enumerate(merges)}
        if u + v not in known and len(u + v) <= 6 and bpe.merge_word(u + v, so_far) == [u, v]:  # as training makes them
            known.append(u + v)
            merges.append((u, v))
    ranks = {p: i for i, p in enumerate(merges)}
    machine = bpe.Automaton(merges)
    reachable = {x for x in known if len(bpe.merge_word(x, ranks)) == 1}
    for _ in range(400):
        word = bytes(pick.randrange(4) for _ in range(pick.randrange(1, 14)))
        assert [machine.labels[i] for i in machine.encode(word)] == bpe.merge_word(word, ranks)
    labels, entered, arcs = explicit(merges)
    number = {x: i for i, x in enumerate(labels)}
    for x in reachable:
        for y in reachable:
            both = bpe.merge_word(x + y, ranks) == [x, y]
            assert machine.arc(machine.number[x], machine.number[y]) == both
            assert (number[y] in arcs[entered[number[x]]]) == both


def test_long_merge_is_the_plain_one():
    v = bpe.vocabulary(PATH)
    ranks = {p: i for i, p in enumerate(v.merges)}
    for word in (b"abcabcabc" * 60, b"the" * 200, bytes(range(65, 91)) * 20):
        plain = [word[i : i + 1] for i in range(len(word))]
        while len(plain) > 1:
            rank, at = min((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(plain, plain[1:], strict=False)))
            if rank == 1 << 60:
                break
            plain[at : at + 2] = [plain[at] + plain[at + 1]]
        assert bpe.merge_word(word, ranks) == plain


def expected(text):
    t = Tokenizer.from_file(PATH)
    ids = t.encode(text or "", add_special_tokens=False).ids
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_documents_as_the_library(spark):
    rows = [(i, x) for i, x in enumerate([*CASES, None, CASES[4], CASES[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS row")
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_documents(docs, PATH).collect()}
    counts = {r.doc_id: tuple(r)[1:] for r in bpe.count_tokens(docs, PATH).collect()}
    for i, x in rows:
        n, ids, decoded = expected(x)
        assert got[i] == (n, ids, decoded), x
        assert counts[i] == (len((x or "").encode()), n, n > 1024), x
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0
    assert bpe.count_tokens(docs.limit(0), PATH).count() == 0


def test_null_and_repeated_keys(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (3, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((r.n_tokens for r in bpe.count_tokens(docs, PATH).collect())) == [0, 1, 2, 2]
    assert bpe.encode_documents(docs, PATH).count() == 4


def test_every_sample_document(spark):
    from rallyplan.llm import queries

    t = Tokenizer.from_file(PATH)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op7_bpe_encode_decode"](spark, "/root/testdata/sf0.001").collect()}
    counts = {r.doc_id: r for r in queries.QUERIES["op9_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        n, ids, decoded = expected(d.text)
        assert tuple(got[d.doc_id])[1:] == (n, ids, decoded)
        assert counts[d.doc_id].n_tokens == len(t.encode(d.text, add_special_tokens=False).ids)


def test_settled_characters_split_alike():
    t = Tokenizer.from_file(PATH).pre_tokenizer
    split = bpe.regex.compile(bpe.PATTERN)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        if bpe.SETTLED.search(c) is None:
            s = f"a{c}b1{c} {c}{c}a"
            assert [m.span() for m in split.finditer(s)] == [o for _, o in t.pre_tokenize_str(s)], hex(ord(c))
