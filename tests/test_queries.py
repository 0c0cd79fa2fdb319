import pytest

from plumbline.plans.queries import ORACLES, QUERIES
from tests.compare import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
