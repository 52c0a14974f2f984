import pytest

from notemill.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(name, spark, sf):
    assert_same(QUERIES[name], ORACLE_SQL[name], spark, sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["valid_recent"](spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThan(c_acctbal,0.0)" in plan and "c_mktsegment" not in plan.split("Physical Plan")[1]
    plan = QUERIES["token_estimate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan
