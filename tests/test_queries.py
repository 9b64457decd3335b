import pytest

from fieldframe.plans import registry
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        assert differs(spark, con, QUERIES[name], SQL[name], SF) is None
    else:
        assert QUERIES[name](spark, SF).count() > 0
