import pytest

from keelson.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_oracle(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert_same(df, catalog.ORACLE_SQL[name], sf_dir)
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_hot_filter_reaches_the_scan(spark, sf_dir):
    df = catalog.QUERIES["partition_pruned"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_main_rows_drop_losers_before_the_shuffle(spark, sf_dir):
    plan = catalog.QUERIES["dedupe_main"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2
