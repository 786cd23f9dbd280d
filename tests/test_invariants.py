"""Invariants between result tables, and the plan rewrites checked against the plain
"""

from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.operators import funnel, segments
from tillroll.plans.model import PRODUCT_VIEW
from tillroll.registry import run_query


def _sum(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_monthly_revenue_adds_up_to_valid_items(small_model):
    f6 = run_query("agg_monthly_kpis", small_model)
    f2 = small_model.fact_order_items_completed
    assert abs(_sum(f6, "total_revenue") - float(_sum(f2, "revenue"))) < 1e-6


def test_yearly_is_monthly_by_year(small_model):
    f6 = run_query("agg_monthly_kpis", small_model)
    f8 = run_query("agg_yearly_kpis", small_model)
    by_year = f6.groupBy(F.year("month").cast("bigint").alias("year")).agg(
        F.sum("total_orders").alias("total_orders"))
    assert spark_rows(by_year) == spark_rows(f8.select("year", "total_orders"))


def test_mom_equals_recomputed(small_model):
    f7 = run_query("agg_monthly_kpis_enriched", small_model).filter(
        F.col("revenue_mom_pct").isNotNull())
    a61 = run_query("mom_recompute_check", small_model).filter(
        F.col("rev_mom_calc").isNotNull())
    assert spark_rows(f7.select("month", F.col("revenue_mom_pct").alias("x"))) == \
        spark_rows(a61.select("month", F.col("rev_mom_calc").alias("x")))


def test_monthly_funnel_is_sum_of_daily(small_model):
    a42 = run_query("agg_daily_funnel", small_model)
    a43 = run_query("agg_monthly_funnel", small_model)
    assert _sum(a42, "product_view_sessions") == _sum(a43, "product_view_sessions")


def test_dq_country_cancellation_is_a6(small_model):
    assert spark_rows(run_query("dq_country_cancellation", small_model)) == \
        spark_rows(run_query("country_cancellation_metrics", small_model))


def test_cancelled_never_exceeds_total(small_model):
    f4 = run_query("final_category_performance", small_model)
    assert f4.filter(F.col("cancelled_orders") > F.col("total_orders")).count() == 0


def test_shares_sum_to_one(small_model):
    f4 = run_query("final_category_performance", small_model)
    assert abs(_sum(f4, "revenue_share") - 1) < 1e-9
    assert abs(_sum(f4, "order_share") - 1) < 1e-9


def _naive_a4(m):
    """The statement's literal plan: every event of a user paired with every item."""
    u, e = m.dim_user.alias("u"), m.fact_events_v1.alias("e")
    oi, p = m.fact_order_items.alias("oi"), m.dim_product.alias("p")
    j = (u.join(e, F.col("u.user_id") == F.col("e.user_id"), "left")
          .join(oi, F.col("u.user_id") == F.col("oi.user_id"), "left")
          .join(p, F.col("oi.product_id") == F.col("p.product_id"), "left"))
    return j.groupBy("u.country", "u.gender", "u.age_group", "p.product_category").agg(
        F.count_if(F.col("e.event_type") == PRODUCT_VIEW).alias("product_views"),
        F.count("oi.product_id").alias("purchases"),
        F.sum("oi.revenue").cast("double").alias("total_revenue"))


def test_factored_segment_join_equals_naive(small_model):
    factored = run_query("country_segment_metrics", small_model)
    assert spark_rows(factored) == spark_rows(_naive_a4(small_model))


def test_factored_category_conversion_equals_naive(small_model):
    m = small_model
    e, oi, p = m.fact_events_v2.alias("e"), m.fact_order_items.alias("oi"), m.dim_product.alias("p")
    j = (e.join(oi, F.col("e.user_id") == F.col("oi.user_id"), "left")
          .join(p, F.col("oi.product_id") == F.col("p.product_id"), "left"))
    naive = j.groupBy("p.product_category").agg(
        F.count_if(F.col("e.event_type") == PRODUCT_VIEW).alias("product_views"),
        F.count("oi.product_id").alias("purchases"))
    factored = segments.category_conversion_global(m).drop("category_conversion_rate")
    assert spark_rows(factored) == spark_rows(naive)


def test_one_scan_funnel_equals_joined_form(small_model):
    m = small_model
    month = F.trunc(F.to_date("created_at"), "MM").alias("month")
    pv = m.events.filter(F.col("event_type") == "product").groupBy(month).agg(
        F.countDistinct("session_id").alias("product_view_sessions"))
    ac = m.events.filter(F.col("event_type") == "cart").groupBy(month).agg(
        F.countDistinct("session_id").alias("add_to_cart_sessions"))
    joined = pv.join(ac, "month", "left")
    one_scan = funnel.agg_funnel_metrics(m).select(
        "month", "product_view_sessions", "add_to_cart_sessions")
    assert spark_rows(one_scan) == spark_rows(joined)
