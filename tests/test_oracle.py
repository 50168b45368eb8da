"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_names_agree():
    assert set(SQL) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, FOLDER, driver.queries()[name], SQL[name]) is None


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_tenant_filter_reaches_the_files(spark):
    for name in ("tenant_view", "metadata_filter"):
        plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan()
        assert "EqualTo(source,src3)" in plan.toString()
