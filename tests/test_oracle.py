"""Every query with oracle SQL gives the same rows on the driver's tables; the others give rows."""

import oracle
import pytest

from rallyplan.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_as_sql(name, spark, con):
    oracle.compare(name, registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(name, spark):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["rally_table", "match_points", "asof_backward", "nearest_event", "hit_dp", "two_players", "match_decode"])
def test_partitions_and_row_order_change_nothing(name, spark, monkeypatch):
    from rallyplan.sources import tracking

    plain = sorted(map(str, registry.QUERIES[name](spark, SF).collect()))
    real = tracking.table
    monkeypatch.setattr(tracking, "table", lambda s, d, t: real(s, d, t).repartition(13).orderBy("event_id", ascending=False) if t == "events" else real(s, d, t))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, registry.QUERIES[name](spark, SF).collect())) == plain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_every_query_is_documented():
    assert all(f.__doc__ for f in registry.QUERIES.values())
