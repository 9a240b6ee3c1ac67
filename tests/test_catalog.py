"""Every query against its SQL, on the smallest tables."""

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from oracle import connect, same

from oxbow.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SMALL), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())


def test_models_hold(spark):
    for r in QUERIES["model_density"](spark, SMALL).collect():
        assert (r.holes, r.duplicates) == (0, 0)
    for r in QUERIES["model_receipt_soundness"](spark, SMALL).collect():
        assert r.unsound == 0
