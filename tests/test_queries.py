"""Each query with SQL against DuckDB on the smallest tables; the others run."""

from pathlib import Path

import pytest

from hunksieve.oracles import ORACLES
from hunksieve.queries import QUERIES

from .compare import connect, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    assert rows
    if name in ORACLES:
        assert (names, rows) == sql_rows(con, ORACLES[name])
