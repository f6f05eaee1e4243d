"""Every named query against its check SQL in DuckDB."""

import pytest
from check import compare, connect

from parcelrules.plans import suite


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


# Point look-ups that may find nothing in the smallest tables.
MAY_BE_EMPTY = {"requirements_by_location"}


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(name, spark, folder, con):
    df = suite.QUERIES[name](spark, folder)
    assert len(set(df.columns)) == len(df.columns)
    if name in suite.CHECK_SQL:
        outcome = compare(df, con, suite.CHECK_SQL[name])
        assert outcome == "" or (outcome == "both empty" and name in MAY_BE_EMPTY)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
