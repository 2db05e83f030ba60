"""Random texts against the libraries and plain definitions."""

import re

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rallyplan.llm import bpe, decontaminate, license_scan, repetition, simhash, url_filter
from rallyplan.llm.common import folded_words

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
texts = st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["the", " ", "\n", "don't", "1234", "é", "日本", "<|endoftext|>", "!!", "  \t", "Ab", "\x85", "　"]), max_size=40).map("".join))


@settings(max_examples=600, deadline=None)
@given(texts)
def test_ids_and_counts_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    codec = bpe.Codec(PATH)
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == want
    assert codec.decode(packed) == LIBRARY.decode(want, skip_special_tokens=False) == text
    v, of = bpe.vocabulary(PATH), bpe.word_counts(PATH, bpe.proven_singles(PATH))
    assert sum(1 if i % 2 else sum(map(of.__getitem__, v.words(s))) for i, s in enumerate(v.sections(text))) == len(want)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_folded_words_are_the_contracts(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in folded_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 2), max_size=60))
def test_suffix_arrays_sort_suffixes(a, b):
    words = [[bytes([x]) for x in w] for w in (a, b)]
    for own, got in zip(words, repetition.longest_repeats(words), strict=True):
        n = len(own)
        for i in range(n):
            best = 0
            for j in range(n):
                k = 0
                while i != j and max(i, j) + k < n and own[i + k] == own[j + k]:
                    k += 1
                best = max(best, k)
            assert got[i] == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), min_size=2, max_size=40, unique=True), st.lists(st.tuples(st.integers(0, 63), st.integers(0, 63)), max_size=40))
def test_links_connect_what_is_near(codes, flips):
    near = {c ^ (1 << a) ^ (1 << b) for c, (a, b) in zip(codes, flips, strict=False)}
    a = np.array(sorted({*codes, *near}), np.uint64)
    forest = simhash.Forest(len(a))
    for i, j in simhash.linked_pairs(a):
        assert np.bitwise_count(a[i] ^ a[j]) <= 2 and forest.link(i, j)
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2)
    roots = forest.roots()
    assert (roots[i] == roots[j]).all()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=":/?#.aAZorgcmesé1-\n", max_size=40))
def test_hosts_and_paths(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url) if "://" in url else None
    host, path = (m[1], m[2]) if m else ("", "")
    assert url_filter.host_and_path(url) == ("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["all", "rights", "reserved", "cc", "by", "general", "public", "license", "x"]), max_size=60))
def test_phrase_places(words):
    raw = [w.encode() for w in words]
    at = {w: [i for i, x in enumerate(raw) if x == w] for w in set(raw)}
    want = sorted((i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    assert license_scan.phrase_places(raw, at) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(97, 100), min_size=1, max_size=70), st.lists(st.integers(97, 100), max_size=70))
def test_common_subsequences(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b):
            old, row[j + 1] = row[j + 1], old + 1 if x == y else max(row[j + 1], row[j])
    got = decontaminate.in_order([bytes([x]) for x in a], [bytes([x]) for x in b])
    assert abs(got - row[-1] / len(a)) < 1e-12
