"""Every registered query equals its DuckDB oracle, row for row, at sf0.001."""

import pytest

from platewise.plans import check, oracle, registry

from tests.conftest import SF_SMALL

KEYS = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    return check.duck_connection(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(oracle.ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    ok, info = check.compare(spark, duck, key, SF_SMALL)
    assert ok, info


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() >= 0
    assert set(registry.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
