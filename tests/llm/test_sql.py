import pytest

from paperloom.llm import queries

from ..oracle import connect, same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    got, expected = same(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLE_SQL[name])
    assert got == expected


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
