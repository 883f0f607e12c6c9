import pytest

import __spark_entry__ as entry
from gridengine.plans import queries as grid

from .oracle import compare


@pytest.mark.parametrize("name", list(grid.QUERIES))
def test_query_against_sql(spark, sf, name):
    df = grid.QUERIES[name](spark, sf)
    if name in grid.ORACLE_SQL:
        assert compare(df, sf, grid.ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(grid.QUERIES) <= set(entry.queries())
