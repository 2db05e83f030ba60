"""Licence scan against brute force."""

import random
import re

import pytest

from rallyplan.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "", "no licence here", "Licensed under CC BY-NC 4.0.", "CC BY cc by CC-BY", "This work is licensed under the GNU General Public License, version 3.", "All rights reserved. all RIGHTS reserved", "all rights\n\nreserved",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "general public licence", "éall rights reserved", "All rights reserved" + " x" * 50_000 + " cc by", "apache", "the the the version 2 0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Permission is hereby denied, free of charge, to any person obtaining a copy of this software", "ALL RİGHTS reserved",
]


def base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for p, label in L.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    labels = ",".join(sorted({x for _, x in places}))
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, labels


def test_base_by_brute_force_and_labels(spark):
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(50, None), (None, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS labels", "1 AS score")
    out = L.scan(docs).collect()
    got = sorted((tuple(r)[:6] for r in out), key=str)
    assert got == sorted(((i, *base(x)) for i, x in rows), key=str)
    labels = {r.doc_id: r.labels for r in out}
    assert [labels[i] for i in (2, 4, 7, 8, 14, 15)] == ["cc-by,cc-by-nc", "gpl", "mit", "apache-2.0", "mit", ""]
    assert all(labels[i] == "" for i in (0, 1, 9, 12, 13))
    assert all(0 <= r.score <= 1 and (r.score > 0) == (r.labels != "") for r in out)
    assert L.scan(docs.limit(0)).count() == 0


def by_every_offset(index, words):
    """Labels of the templates that stand at some offset, without the index."""
    number = [index.number.get(w, -1) for w in words]
    every = {}
    for t, own in enumerate(index.ids):
        for start in range(-len(own) - L.DRIFT, len(words)):
            hits = [i for i, w in enumerate(own) if any(0 <= start + i + d < len(words) and number[start + i + d] == w for d in range(L.DRIFT + 1))]
            share = float(index.mass[t][hits].sum()) / index.weight[t] if hits else 0.0
            if share >= L.LEAST_SHARE and all(index.stands(words, k, start, len(own) + L.DRIFT) for k in index.keys[t]):
                every[index.labels[t]] = max(every.get(index.labels[t], 0.0), share)
    return every


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_what_comparing_every_offset_finds(seed):
    """Under skewed counts, with words changed (the rarest ones first), put in and left out."""
    pick = random.Random(seed)
    index = L.Index(10_000, {w: int(10_000 * pick.random() ** (1 + 4 * seed)) for w in L.vocabulary()} if seed else {})
    met = 0
    for t, (_, own, _) in enumerate(L.TEMPLATES):
        if len(own) > 60 and t % 3 != seed % 3:
            continue
        changed = set(sorted(set(own), key=lambda w: -index.idf[w])[: pick.randrange(0, 5)]) if pick.random() < 0.7 else set()
        text = [w if w not in changed else b"changed" for w in own]
        for _ in range(pick.randrange(0, 3)):
            text.insert(pick.randrange(len(text)), b"put")
        words = [b"pre"] * pick.randrange(9) + text + [b"the", b"of", b"license", b"software"] * 3
        at = {w: [i for i, x in enumerate(words) if x == w] for w in set(words) & L.vocabulary()}
        want = by_every_offset(index, words)
        got = index.find(words, at)
        assert set(got) == set(want) and all(abs(got[x][0] - want[x]) < 1e-6 for x in got)
        met += len(got)
    assert met > 10


def test_licence_texts_are_found_with_names_put_in(spark):
    texts = [" ".join(w for w in text.split()).replace("opyright", "opyright (c) 2024") for _, text, _ in L.TEXTS]
    got = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(L.TEXTS[r.doc_id][0] in r.labels.split(",") for r in got)
