"""Queries of the corpus operators against their SQL, on the whole small tables."""
import pytest

from conftest import SF_DIR
from tallyspark.checks.compare import connect, rows_of_spark, rows_of_sql
from tallyspark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, SF_DIR))
    want_columns, want = rows_of_sql(connect(SF_DIR), ORACLES[name])
    assert columns == want_columns
    assert rows and rows == want
