"""Segment tables with a user-level many-to-many join (A4, A5, A19, A20) and their
de-multiplied companions (decision D9).

The statements join every event of a user with every item of that user, so a user's
rows multiply (events x items).  The same sums come from one row per user on each side:

    product views  = sum(views_u * items_uc)      purchases = sum(events_u * items_uc)
    revenue        = sum(events_u * revenue_uc)

with a missing side counting as the single NULL row an outer join produces.  Both sides
are aggregated per user first, so the join holds at most one row per (user, category)
and no pairs are ever formed; a user owning a large share of the rows is collapsed by
the map-side partial aggregate before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import attach_total, safe_divide
from tillroll.plans.model import PRODUCT_VIEW, Model, shared

SEGMENT = ["country", "gender", "age_group"]


def _events_per_user(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == PRODUCT_VIEW).alias("n_views"))


@shared
def _items_per_user_category(m: Model) -> DataFrame:
    j = m.fact_order_items.join(m.dim_product, "product_id", "left")
    return j.groupBy("user_id", "product_category").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("product_id").alias("n_products"),
        F.sum("revenue").alias("revenue"))


@shared
def country_segment_metrics(m: Model) -> DataFrame:
    """A4: dim_user LEFT JOIN fact_events (v1) LEFT JOIN fact_order_items LEFT JOIN
    dim_product, by country, gender, age band, category - the multiplied counts."""
    eu = _events_per_user(m.fact_events_v1)
    iu = _items_per_user_category(m)
    j = m.dim_user.join(eu, "user_id", "left").join(iu, "user_id", "left")
    ev = F.coalesce(F.col("n_events"), F.lit(1))
    return j.groupBy(*SEGMENT, "product_category").agg(
        F.sum(F.coalesce(F.col("n_views"), F.lit(0)) * F.coalesce(F.col("n_rows"), F.lit(1)))
        .alias("product_views"),
        F.sum(ev * F.coalesce(F.col("n_products"), F.lit(0))).alias("purchases"),
        F.sum(ev * F.col("revenue")).alias("total_revenue"))


def dq_segment_totals(m: Model) -> DataFrame:
    """A5: totals of A4."""
    return country_segment_metrics(m).agg(
        F.sum("product_views").alias("product_views"),
        F.sum("purchases").alias("purchases"))


def demographic_category_preferences(m: Model) -> DataFrame:
    """A4 re-aggregated to age band, gender, category."""
    return country_segment_metrics(m).groupBy("age_group", "gender", "product_category").agg(
        F.sum("purchases").alias("total_purchases"),
        F.sum("total_revenue").alias("total_revenue"))


def category_conversion_global(m: Model) -> DataFrame:
    """fact_events (v2) LEFT JOIN fact_order_items LEFT JOIN dim_product by
    category - the multiplied counts."""
    eu = _events_per_user(m.fact_events_v2)
    iu = _items_per_user_category(m)
    j = eu.join(iu, "user_id", "left")
    g = j.groupBy("product_category").agg(
        F.sum(F.col("n_views") * F.coalesce(F.col("n_rows"), F.lit(1))).alias("product_views"),
        F.sum(F.col("n_events") * F.coalesce(F.col("n_products"), F.lit(0))).alias("purchases"))
    return g.select("product_category", "product_views", "purchases",
                    safe_divide(F.col("purchases"), F.col("product_views")).alias(
                        "category_conversion_rate"))


def country_segment_metrics_unfanned(m: Model) -> DataFrame:
    """D9 for A4: purchases and revenue by segment and category from the items alone;
    product views (which carry no product) by segment from the events alone, repeated on
    each category row of the segment."""
    iu = _items_per_user_category(m)
    items = m.dim_user.join(iu, "user_id", "left").groupBy(*SEGMENT, "product_category").agg(
        F.sum(F.coalesce(F.col("n_products"), F.lit(0))).alias("purchases"),
        F.sum("revenue").alias("total_revenue"))
    eu = _events_per_user(m.fact_events_v1)
    views = m.dim_user.join(eu, "user_id", "inner").groupBy(*SEGMENT).agg(
        F.sum("n_views").alias("segment_product_views"))
    cond = [items[c].eqNullSafe(views[c]) for c in SEGMENT]
    return items.join(views, cond, "left").select(
        *[items[c] for c in SEGMENT], "product_category",
        F.coalesce(F.col("segment_product_views"), F.lit(0)).alias("segment_product_views"),
        "purchases", "total_revenue")


def category_conversion_global_unfanned(m: Model) -> DataFrame:
    """D9 for A19: purchases by category of users with at least one (v2) event, over all
    (v2) product views."""
    ev = m.fact_events_v2
    active = ev.select("user_id").distinct()   # hot users collapse before the semi join
    views = ev.agg(F.count_if(F.col("event_type") == PRODUCT_VIEW).alias("product_views"))
    items = _items_per_user_category(m).join(active, "user_id", "left_semi")
    g = items.groupBy("product_category").agg(F.sum("n_products").alias("purchases"))
    j = attach_total(g, views, "product_views")
    return j.select("product_category", "product_views", "purchases",
                    safe_divide(F.col("purchases"), F.col("product_views")).alias(
                        "category_conversion_rate"))
