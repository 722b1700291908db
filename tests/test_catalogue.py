"""Every registered query with SQL agrees with it; the others run and keep their invariants."""

import pytest
from compare import differences, duck

from pitwise.plans import catalogue

SF = "/root/testdata/sf0.001"
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, con, name):
    assert differences(catalogue.queries()[name](spark, SF), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(ORACLES)))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
