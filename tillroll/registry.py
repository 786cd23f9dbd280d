"""Every result table by key.  ``run_query`` returns the output form (see ``present``)."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import present
from tillroll.operators import (
    category,
    distribution,
    funnel,
    geography,
    growth,
    maintained,
    product,
    quality,
    seasonality,
    segments,
)
from tillroll.plans.model import Model


def _attr(name: str) -> Callable[[Model], DataFrame]:
    return lambda m: getattr(m, name)


# The last full year of the generated tables.
INSPECTED_YEAR = 2024

QUERIES: dict[str, Callable[[Model], DataFrame]] = {
    # star-schema layer
    "fact_order_items_all": _attr("fact_order_items_all"),                 # F1
    "fact_order_items_completed": _attr("fact_order_items_completed"),     # F2
    "dim_product": _attr("dim_product"),                                   # F3
    "dim_user": _attr("dim_user"),                                         # A2
    "fact_events_v1": _attr("fact_events_v1"),                             # A3
    "fact_events_v2": _attr("fact_events_v2"),                             # A13
    "fact_events_all": _attr("fact_events_all"),                           # A39
    "fact_order_items": _attr("fact_order_items"),                         # D1
    "fact_orders": _attr("fact_orders"),                                   # D2
    # page 1: category portfolio
    "final_category_performance": category.final_category_performance,    # F4
    "category_segments": category.category_segments,                      # R7
    "portfolio_concentration": category.portfolio_concentration,          # R8
    "portfolio_headline": category.portfolio_headline,                    # R10
    # page 2: funnels
    "agg_funnel_metrics": funnel.agg_funnel_metrics,                      # F5
    "agg_daily_funnel": funnel.agg_daily_funnel,                          # A42
    "agg_monthly_funnel": funnel.agg_monthly_funnel,                      # A43
    "funnel_dropoff": funnel.funnel_dropoff,                              # R3
    "conversion_trend": funnel.conversion_trend,                          # R4
    # page 3: growth
    "agg_monthly_kpis": growth.agg_monthly_kpis,                          # F6
    "agg_monthly_kpis_enriched": growth.agg_monthly_kpis_enriched,        # F7
    "agg_yearly_kpis": growth.agg_yearly_kpis,                            # F8
    "agg_yearly_kpis_enriched": growth.agg_yearly_kpis_enriched,          # F9
    "monthly_revenue_global": growth.monthly_revenue_global,              # A31
    "monthly_purchasing_users": growth.monthly_purchasing_users,          # A32
    "monthly_cancellation_rate": growth.monthly_cancellation_rate,        # A33
    "monthly_cancelled_revenue": growth.monthly_cancelled_revenue,        # A34
    "monthly_revenue_per_order": growth.monthly_revenue_per_order,        # A35
    "monthly_revenue_per_user": growth.monthly_revenue_per_user,          # A36
    "cagr": growth.cagr,                                                  # R1
    "growth_multiple": growth.growth_multiple,                            # R2
    "revenue_decomposition": growth.revenue_decomposition,                # R5
    "growth_pattern": growth.growth_pattern,                              # R6
    "revenue_per_user_stability": growth.revenue_per_user_stability,      # R9
    # geography and demographics
    "country_cancellation_metrics": geography.country_cancellation_metrics,    # A6
    "country_browsing_metrics_v1": geography.country_browsing_metrics_v1,      # A7
    "country_browsing_metrics_v2": geography.country_browsing_metrics_v2,      # A9
    "country_cart_metrics": geography.country_cart_metrics,                    # A10
    "country_purchase_users": geography.country_purchase_users,                # A11
    "country_cart_purchase_funnel": geography.country_cart_purchase_funnel,    # A12
    "country_revenue": geography.country_revenue,                              # A15
    "revenue_share": geography.revenue_share,                                  # A16
    "revenue_per_user": geography.revenue_per_user,                            # A17
    "country_performance_summary": geography.country_performance_summary,      # A21
    "agg_country_kpis": geography.agg_country_kpis,                            # A37
    "agg_country_user_base_v1": geography.agg_country_user_base_v1,            # A45
    "agg_country_user_base_v2": geography.agg_country_user_base_v2,            # A47
    "final_country_performance_v1": geography.final_country_performance_v1,    # A46
    "final_country_performance_v2": geography.final_country_performance_v2,    # A48
    "final_country_performance_merged": geography.final_country_performance_merged,  # D6
    "revenue_variance_by_country": geography.revenue_variance_by_country,      # A49
    "revenue_variance_by_demographic": geography.revenue_variance_by_demographic,  # A50
    # segments (many-to-many user join)
    "country_segment_metrics": segments.country_segment_metrics,               # A4
    "dq_segment_totals": segments.dq_segment_totals,                           # A5
    "category_conversion_global": segments.category_conversion_global,         # A19
    "demographic_category_preferences": segments.demographic_category_preferences,  # A20
    "country_segment_metrics_unfanned": segments.country_segment_metrics_unfanned,  # D9
    "category_conversion_global_unfanned": segments.category_conversion_global_unfanned,  # D9
    # product, brand, category
    "category_purchase_intensity": product.category_purchase_intensity,        # A22
    "category_cancellation_variance": product.category_cancellation_variance,  # A24
    "product_cancellation": product.product_cancellation,                      # A25
    "price_vs_cancellation": product.price_vs_cancellation,                    # A26
    "hero_products": product.hero_products,                                    # A27
    "product_performance_summary": product.product_performance_summary,        # A28
    "category_cancellation_risk": product.category_cancellation_risk,          # A29
    "brand_performance_summary": product.brand_performance_summary,            # A30
    "aggregate_category_kpis": product.aggregate_category_kpis,                # A38
    "revenue_by_category": product.revenue_by_category,                        # A53
    "month_category_revenue": product.month_category_revenue,                  # A63
    # distribution
    "user_revenue_distribution": distribution.user_revenue_distribution,       # A51
    "user_revenue_by_country": distribution.user_revenue_by_country,           # A52
    "category_user_skew": distribution.category_user_skew,                     # A54
    # seasonality
    "seasonality_by_month_number": seasonality.seasonality_by_month_number,    # A55
    "seasonality_by_year_month": seasonality.seasonality_by_year_month,        # A56
    "seasonality_by_month_name": seasonality.seasonality_by_month_name,        # A57
    "seasonality_2020_2025": seasonality.seasonality_2020_2025,                # A58
    "seasonality_sign_counts": seasonality.seasonality_sign_counts,            # A59
    "inspect_year": partial(seasonality.inspect_year, year=INSPECTED_YEAR),    # A60
    "mom_recompute_check": seasonality.mom_recompute_check,                    # A61
    "country_month_kpis": seasonality.country_month_kpis,                      # D4
    "seasonality_by_country": seasonality.seasonality_by_country,              # A62
    # data quality
    "dq_product_event_identity": quality.dq_product_event_identity,            # A8
    "dq_funnel_users": quality.dq_funnel_users,                                # A14
    "dq_country_cancellation": quality.dq_country_cancellation,                # A23
    "dq_null_event_users": quality.dq_null_event_users,                        # A40
    "dq_sessions_users": quality.dq_sessions_users,                            # A41
    # served from maintained state (F6, A31-A36, distinct counts over time)
    "agg_monthly_kpis_maintained": maintained.agg_monthly_kpis_maintained,
    "monthly_reports_maintained": maintained.monthly_reports_maintained,
    "distinct_by_period": maintained.distinct_by_period,
}

#: Keys that serve the same numbers as others in another way; the bench times them apart.
MAINTAINED = ("agg_monthly_kpis_maintained", "monthly_reports_maintained", "distinct_by_period")


#: ORDER BY of statements whose operators leave it out, because other tables read them.
ORDER: dict[str, tuple[str, ...]] = {
    "agg_funnel_metrics": ("month",), "agg_daily_funnel": ("event_date",), "agg_monthly_funnel": ("month",),
    "agg_monthly_kpis": ("month",), "agg_monthly_kpis_enriched": ("month",),
    "agg_yearly_kpis": ("year",), "agg_yearly_kpis_enriched": ("year",),
    "country_cart_purchase_funnel": ("cart_to_purchase_conversion",),
    "agg_country_kpis": ("total_revenue DESC",), "aggregate_category_kpis": ("total_revenue DESC",),
    "agg_monthly_kpis_maintained": ("month",), "monthly_reports_maintained": ("month",),
    "distinct_by_period": ("grain", "period"),
}


def run_query(key: str, model: Model) -> DataFrame:
    """The result table ``key`` over ``model``, in output form and in the statement's order."""
    out = present(QUERIES[key](model))
    return out.orderBy(*[F.expr(c.removesuffix(" DESC")).desc() if c.endswith(" DESC") else F.expr(c)
                         for c in ORDER[key]]) if key in ORDER else out
