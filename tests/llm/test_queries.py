import pytest
from compare import duck, same

from corvane.llm import queries as llm

Q, SQL = llm.queries(), llm.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    same(Q[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_query_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert not set(SQL) - set(Q)
