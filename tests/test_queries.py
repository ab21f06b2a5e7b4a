import pytest

import __spark_entry__ as entry
from tests.oracle import assert_same, connect

from brinegrid.queries import prep, reference

OWN = {**prep.QUERIES, **reference.QUERIES}
SQL = {**prep.SQL, **reference.SQL}


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tiny, con, name):
    assert_same(OWN[name](spark, tiny), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(OWN) - set(SQL)))
def test_query_without_sql_runs(spark, tiny, name):
    assert OWN[name](spark, tiny).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.count() > 0
    assert "sst" in df.columns
