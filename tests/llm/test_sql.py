import pytest

from gridengine.llm import queries

from .oracle import same


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    same(queries.QUERIES[name](spark, sf), sf, queries.ORACLE_SQL[name])
