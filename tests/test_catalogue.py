import pytest

from chronolith.plans import catalogue
from tests.conftest import DATA
from tests.oracle import agrees, connection


@pytest.fixture(scope="module")
def con():
    return connection(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_oracle(spark, con, name):
    agrees(catalogue.QUERIES[name](spark, DATA), con, catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
