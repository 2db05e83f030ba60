"""Fill-in-middle: units, forms and round trips against a plain version."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from rallyplan.llm import infill as I

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
AUTOMATON = I.event_automaton()


def plain_version(key, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def own_version(key, text):
    x = I.transform(key, text, AUTOMATON)
    return x.n, x.form, None if x.prefix is None else len(x.prefix), None if x.middle is None else len(x.middle), x.output


@settings(max_examples=400, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.sampled_from([" ", "\t", "\n", "\x0b", "\x0c", "\r", "a", "bc", "é", "𝒳", " ", " ", "<", ">", "<P", "S>", "<M>", "P", "<<"]), max_size=30).map("".join))
def test_random_texts(key, text):
    assert own_version(key, text) == plain_version(key, text)
    x = I.transform(key, text, AUTOMATON)
    assert I.restore(x.output, x.form, AUTOMATON) == text


@pytest.mark.parametrize("text, n", [("", 0), ("   ", 1), ("ab", 1), (" ab", 1), ("ab ", 2), ("ab  cd", 2), (" a b ", 3), ("a\r\nb\n", 3), (" ", 1)])
def test_units(text, n):
    events = I.scan(text, AUTOMATON)
    assert events.n_units == n == len(UNIT.findall(text))
    ends = [m.end() for m in UNIT.finditer(text)]
    assert [I.unit_end(events, r, len(text)) for r in range(n + 1)] == [0, *ends]


def test_parts_that_look_like_halves_of_sentinels():
    for form in (I.PSM, I.SPM):
        parts = {I.PREFIX: "x<S", I.MIDDLE: ">y<M", I.SUFFIX: "P><"}
        output = "".join(mark + parts[mark] for mark in I.ORDER[form])
        assert I.restore(output, form, AUTOMATON) == "x<S>y<MP><"


def test_odd_rows(spark):
    long = "word " * 400_000 + "end"
    rows = [(1, None, "x"), (2, "", "x"), (3, "has <M> inside", None), (None, "a b c", "y"), (4, long, "y"), (4, long, "y"), (5, "  \n ", "z"), (6, "é 𝒳 b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    found = I.digests(docs).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t, _ in rows:
        n, form, p, m, out = plain_version(k, t)
        want.append((k, n, form, p, m, sha(out), sha(t or "")))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert I.digests(docs.limit(0)).count() == 0


def test_texts_come_back(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    made = I.infill(docs)
    assert {r.form for r in made.collect()} == {"plain", "psm", "spm"}
    assert sorted(I.restored(made).collect()) == sorted((r.doc_id, r.text or "") for r in docs.collect())
