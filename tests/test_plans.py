"""Plan checks: no cartesian product, no Python evaluation, pruned scans, pushed filters."""

import pytest

from tillroll.plans.model import Model
from tillroll.registry import QUERIES, run_query

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_cartesian_or_python(small_model, key):
    plan = plan_of(run_query(key, small_model))
    for node in FORBIDDEN:
        assert node not in plan, f"{key}: {node} in plan"


def test_scan_prunes_columns(small_model):
    plan = plan_of(run_query("final_category_performance", small_model))
    lineitem_scan = [ln for ln in plan.splitlines() if "lineitem" in ln or "l_orderkey" in ln]
    assert lineitem_scan
    text = "\n".join(lineitem_scan)
    for unused in ("l_quantity", "l_discount", "l_tax", "l_shipdate", "l_comment"):
        assert unused not in text


def test_status_filter_reaches_materialised_scan(spark, small_model, tmp_path):
    from tillroll.plans.warehouse import materialize
    m = materialize(small_model, str(tmp_path / "wh"))
    df = run_query("hero_products", m)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,Complete)" in text


def test_materialised_model_gives_same_results(spark, small_model, tmp_path):
    from tests.helpers import spark_rows
    from tillroll.plans.warehouse import materialize
    m = materialize(small_model, str(tmp_path / "wh2"))
    for key in ("final_category_performance", "agg_funnel_metrics", "country_segment_metrics"):
        assert spark_rows(run_query(key, m)) == spark_rows(run_query(key, small_model))


def test_model_from_canonical_tables(spark, tmp_path):
    from tillroll.plans.warehouse import materialize
    from tillroll.sources.canonical import load_canonical
    m = Model.from_testdata(spark, "/root/testdata/sf0.001")
    materialize(m, str(tmp_path / "wh3"))
    again = Model(load_canonical(spark, str(tmp_path / "wh3")))
    assert again.order_items.count() == m.order_items.count()


SHARED_READERS = [
    "final_category_performance", "category_segments", "portfolio_concentration",
    "agg_monthly_kpis_enriched", "agg_yearly_kpis_enriched", "cagr", "growth_pattern",
    "revenue_per_user_stability", "seasonality_by_month_number", "seasonality_sign_counts",
    "mom_recompute_check", "funnel_dropoff", "conversion_trend", "agg_monthly_funnel",
    "country_performance_summary", "revenue_share", "final_country_performance_v2",
    "final_country_performance_merged", "dq_segment_totals",
    "demographic_category_preferences", "seasonality_by_country",
    "revenue_variance_by_country", "user_revenue_distribution", "category_user_skew",
]


def test_shared_tables_give_same_results(spark, tmp_path):
    from tests.helpers import spark_rows
    from tillroll.plans.warehouse import materialize, materialize_shared
    lazy = Model.from_testdata(spark, "/root/testdata/sf0.001")
    stored = materialize_shared(materialize(lazy, str(tmp_path / "wh")), str(tmp_path / "wh"))
    for key in SHARED_READERS:
        plan = plan_of(run_query(key, stored))
        assert "_shared" in plan, key
        assert spark_rows(run_query(key, stored)) == spark_rows(run_query(key, lazy)), key


@pytest.mark.parametrize("key", ["agg_monthly_kpis", "country_month_kpis", "final_category_performance", "portfolio_headline",
                                 "agg_country_kpis", "aggregate_category_kpis", "revenue_decomposition", "dq_funnel_users"])
def test_distinct_counts_copy_no_rows(small_model, key):
    """Distinct counts come from flags per entity, not from a copy of every row per count."""
    plan = run_query(key, small_model)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "CartesianProduct" not in plan
