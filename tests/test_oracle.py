"""Every query of the core against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from stewardspark.plans import oracle, registry
from tests.conftest import SMALL
from tools.check import connect, differences


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


def test_every_query_has_its_sql():
    assert set(registry.queries()) == set(oracle.oracle_sql())


def test_entry_offers_them_all():
    assert set(registry.queries()) <= set(entry.queries())
    assert oracle.oracle_sql().items() <= entry.oracle_sql().items()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["sprint_id", "team", "category", "score"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, db, name):
    df = registry.queries()[name](spark, SMALL)
    assert differences(df, db, oracle.oracle_sql()[name]) is None
