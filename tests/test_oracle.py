"""Every query that has SQL gives the SQL's rows."""

import pytest
from compare import duck_rows, spark_rows

from tidemark import catalog, oracle


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    columns, want = duck_rows(small, oracle.SQL[name])
    assert sorted(df.columns) == columns
    assert spark_rows(df) == want


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
