"""Every query of the package that has a SQL twin gives the same rows as DuckDB."""

import pytest

from litscreen.llm.catalog import ORACLES, QUERIES
from tests.oracle import compare, duckdb_connection

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duckdb_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    assert compare(QUERIES[name](spark, SF_DIR), connection, ORACLES[name]) is None
