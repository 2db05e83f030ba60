"""Plans: what is read, where Python runs, and that nothing is crossed."""

import re

import pytest

from rallyplan.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
MAPS = ["op1_license_scan", "op2_url_filter", "op3_decontamination", "op5_quality_classifier", "op6_quality_rules", "op7_bpe_encode_decode", "op9_token_counts", "op11_fill_in_middle"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_sharding", "op8_pii_spans"])
def test_native_ones_have_no_python(name, spark):
    assert not re.search("Python|Pandas|Arrow", plan(spark, name))


@pytest.mark.parametrize("name", MAPS)
def test_map_passes_shuffle_nothing_and_read_two_columns(name, spark):
    p = plan(spark, name)
    assert "Exchange" not in p and "Join" not in p
    key, text = ("page_id", "url") if name.startswith("op2") else ("doc_id", "text")
    assert re.findall(r"ReadSchema: struct<([^>]*)>", p) == [f"{key}:bigint,{text}:string"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nothing_is_crossed(name, spark):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))
