"""Results do not depend on the caller's session settings: ANSI mode, AQE and the session
time zone are switched for a representative subset of keys (the driver's own session may
differ from ours)."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.helpers import assert_same, duck_on_generated, duck_rows, spark_rows

KEYS = ["final_category_performance", "agg_funnel_metrics", "agg_daily_funnel",
        "agg_monthly_kpis_enriched", "revenue_share", "agg_country_kpis",
        "country_segment_metrics", "seasonality_by_month_name", "fact_events_all",
        "brand_performance_summary", "revenue_decomposition"]
SETTINGS = {"spark.sql.ansi.enabled": "false", "spark.sql.adaptive.enabled": "false",
            "spark.sql.session.timeZone": "America/Los_Angeles"}


@pytest.fixture(scope="module")
def other_settings(spark):
    old = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def con():
    return duck_on_generated(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_same_results_under_other_settings(other_settings, con, key):
    df = entry.queries()[key](other_settings, SF_SMALL)
    assert_same(spark_rows(df), duck_rows(con, entry.oracle_sql()[key]), key)
