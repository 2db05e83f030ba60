"""Plans: one shuffle where one is enough, predicates and columns down to the scan."""

import re

import pytest

from rallyplan.plans import registry

SF = "/root/testdata/sf0.001"
ONE = ["rally_table", "shot_errors", "match_points", "scoring_stats", "session_kind", "playing_summary", "playing_review", "insights", "asof_backward", "hit_dp", "two_players", "range_peak", "profile_technique", "category_counts"]


def plan(spark, name):
    return registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ONE)
def test_one_shuffle(name, spark):
    assert len(re.findall("Exchange hashpartitioning", plan(spark, name))) == 1


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES)))
def test_nothing_is_crossed(name, spark):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


def test_scans_are_pruned(spark):
    p = plan(spark, "semi_in")
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in p
    assert "html" not in plan(spark, "safe_names")
