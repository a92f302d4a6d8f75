"""Every named query against its SQL text."""
import pytest

from conftest import SF_DIR
import __spark_entry__ as contract
from tallyspark.checks.compare import connect, rows_of_spark, rows_of_sql

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query_equals_sql(spark, con, name):
    columns, rows = rows_of_spark(contract.queries()[name](spark, SF_DIR))
    assert rows
    if name in ORACLES:
        want_columns, want = rows_of_sql(con, ORACLES[name])
        assert columns == want_columns
        assert rows == want


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "session"
