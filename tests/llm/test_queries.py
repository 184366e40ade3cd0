"""The text queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from hunksieve.llm.queries import ORACLES, QUERIES

from ..compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert spark_rows(QUERIES[name](spark, SF_DIR)) == sql_rows(connect(SF_DIR), ORACLES[name])
