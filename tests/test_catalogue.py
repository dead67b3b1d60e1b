import pytest

from compare import DATA, duck, same
from textgraph.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        same(spark, con, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, DATA).count() > 0
