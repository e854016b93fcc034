"""Every registered query with SQL gives the SQL's rows; every other one gives rows."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, oracle_connection
from panelfill.catalog import QUERIES as REPORTS

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_the_sql(spark, con, name):
    ok, note = compare(spark, con, name, FOLDER)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(REPORTS) - set(entry.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    rows = entry.queries()[name](spark, FOLDER)
    assert rows.columns == [c for c, _ in rows.dtypes] and rows.count() > 0


def test_entry_is_lazy_and_stable(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["attribute", "sakey", "svkey"] and df.count() > 0


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
