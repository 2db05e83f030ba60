"""The pipeline against a plain version of its stages."""

import hashlib
import re
import struct

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from rallyplan.llm import pii
from test_near_copies import brute_roots
from test_repetition import brute as judged

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {d: t for d, t in docs.items() if judged(t)[6]}
    ids = sorted(kept)
    firsts = sorted(set(brute_roots([kept[d] for d in ids])))  # of each group of near copies the first
    kept = {ids[i]: kept[ids[i]] for i in firsts}
    kept = {d: t for d, t in kept.items() if not any(i in t for i in items)}
    frame = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(frame).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for d, text in kept.items():
        at, out = 0, ""
        for x in filter(None, spans[d].split(",")):
            kind, s, e = x.split(":")
            if int(s) >= at:
                out += f"{text[at : int(s)]}<{kind}>"
            at = max(at, int(e))
        ids = t.encode(out + text[at:], add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[d] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((out + text[at:]).encode()).hexdigest())
        assert not re.search(r"[A-Za-z0-9]@[a-z0-9]+\.[a-z]", out + text[at:])
    got = {r.doc_id: tuple(r)[1:] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    """Two texts under one doc_id both stay, through all stages."""
    texts = [" ".join(f"{x}{i}" for i in range(60)) + ". Then it was said again." for x in ("river", "stone", "cloud")]
    docs = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (3, None), (3, "")], "doc_id long, text string").selectExpr("*", "'en' AS lang", "'a' AS source", "CAST(length(text) AS LONG) AS n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        if name == "quality_rules":
            assert docs.count() == 4
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(1, texts[0]), (1, texts[1]), (None, texts[2])], key=str)
