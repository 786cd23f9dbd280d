"""Every registered result table equals its independent DuckDB statement on the
generated tables (the driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.helpers import assert_same, duck_on_generated, duck_rows, spark_rows
from tillroll.registry import QUERIES

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck_on_generated(SF_SMALL)


def test_every_query_has_an_oracle():
    """Training-data operators have their own tests; only some of them are expressible in SQL."""
    assert set(KEYS) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF_SMALL)
    assert_same(spark_rows(df), duck_rows(con, entry.oracle_sql()[key]), key)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "revenue_share" in df.columns
