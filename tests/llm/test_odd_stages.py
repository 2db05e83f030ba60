"""Every stage on nulls in any column, repeated rows, very long texts, and columns whose names the operators use themselves."""

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASH = "'x' AS fp, 1 AS component_id, 2 AS kept, 'y' AS spans, 3 AS __spans, 4 AS __place, 5 AS n_tokens, 6 AS k, 7 AS g, 8 AS label, 9 AS at, 10 AS item_id, 11 AS x"


@pytest.fixture(scope="module")
def docs(spark):
    text = "One plain sentence of some twenty different words, which goes on for a while so that no rule about short texts takes it away, mail joe@x.de."
    other = "Another text altogether: it speaks about rivers, herons, wooden piers and the long way home, and then ends after quite enough words for anyone."
    rows = [
        (1, text, "en", "a", len(text)), (1, text, "en", "a", len(text)), (2, text, None, None, None), (None, text, "en", "b", 3), (None, other, None, "b", None), (None, other, None, "b", None),
        (3, None, "en", "c", 0), (4, "", None, None, 0), (5, "w" * 200_000, "en", "d", 200_000), (6, " ".join(f"word{i}" for i in range(30_000)), "en", "d", None), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *CLASH.split(", "))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(name, stage, docs, spark):
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.dtypes == docs.dtypes
    ids = sorted((r.doc_id for r in rows), key=str)
    want = {
        "quality_rules": [1, 1, 2, 6, None, None, None], "simhash_near_dedup": [1, 3, 5, 6, None], "decontamination": [1, 1, 2, 3, 4, 5, 6, None, None, None, None],
        "pii": [1, 1, 2, 3, 4, 5, 6, None, None, None, None], "bpe_encoding": [1, 1, 2, 3, 4, 5, 6, None, None, None, None],
    }
    assert ids == sorted(want[name], key=str)
    if name == "pii":
        assert sum("mail <email>" in (r.text or "") for r in rows) == 4 and all("joe@" not in (r.text or "") for r in rows)
        assert {r.n_chars for r in rows if r.doc_id == 1} == {len("One plain sentence of some twenty different words, which goes on for a while so that no rule about short texts takes it away, mail joe@x.de.") - len("joe@x.de.") + len("<email>.")}


def test_all_stages_in_turn_on_an_empty_table(docs, spark):
    frame = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.count() == 0
