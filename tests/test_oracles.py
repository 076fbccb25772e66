import os

import pytest

from annalist.plans import queries
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert got == want


def test_entry_module_lists_every_query():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship_query_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.columns
    rows.count()
