import pytest

from tests import oracle
from tidemill.plans import catalogue, flows, parity  # noqa: F401 - they register their queries


@pytest.fixture(scope="module")
def db():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    oracle.same(catalogue.queries()[name](spark, oracle.SF), db, catalogue.oracle_sql()[name])


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())
