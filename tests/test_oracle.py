"""Every registered query against its SQL on the smallest tables."""

import pytest

from clauselake.queries import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
FOUND, SQL = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(FOUND[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(FOUND) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = FOUND[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_needs_no_session_to_list():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
