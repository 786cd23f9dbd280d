"""Page 2: conversion funnels (F5, A42, A43) and the funnel measures.

Distinct counts of several conditional sets are taken by first reducing the events to
distinct (group, stage, id) rows and then counting rows per stage: one shuffle over the
reduced set instead of one copy of every event per distinct expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import month_start, safe_divide
from tillroll.plans.model import CART, PRODUCT_VIEW, PURCHASE, Model, shared


def _count_stage(stage: str) -> Column:
    return F.count_if((F.col("event_type") == stage) & F.col("id").isNotNull())


def _stage_distincts(df: DataFrame, group: str, id_of_stage: Column) -> DataFrame:
    """Distinct (group, event_type, id); rows whose id is NULL are kept so that a group
    seen only through anonymous events still exists (its counts are then 0)."""
    return df.select(group, "event_type", id_of_stage.alias("id")).distinct()


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        safe_divide(F.col("add_to_cart_sessions"), F.col("product_view_sessions")).alias(
            "view_to_cart_rate"),
        safe_divide(F.col("purchasing_users"), F.col("add_to_cart_sessions")).alias(
            "cart_to_purchase_rate"),
        safe_divide(F.col("purchasing_users"), F.col("product_view_sessions")).alias(
            "view_to_purchase_rate"),
    )


@shared
def agg_funnel_metrics(m: Model) -> DataFrame:
    """per month with at least one product view: distinct view sessions, distinct cart
    sessions, distinct valid buyers (from orders).  Views and carts come from one scan of
    the events; a month without carts or buyers gets NULL (the statement left-joins from
    the view months), and a NULL month matches nothing."""
    ev = (m.events.filter(F.col("event_type").isin(PRODUCT_VIEW, CART))
          .withColumn("month", month_start(F.to_date("created_at"))))
    stages = _stage_distincts(ev, "month", F.col("session_id")).groupBy("month").agg(
        _count_stage(PRODUCT_VIEW).alias("product_view_sessions"),
        _count_stage(CART).alias("add_to_cart_sessions"),
        # a month exists for a stage if it has any event of it, even with NULL sessions only
        F.count_if(F.col("event_type") == PRODUCT_VIEW).alias("_has_views"),
        F.count_if(F.col("event_type") == CART).alias("_has_carts"))
    stages = stages.filter(F.col("_has_views") > 0).select(
        "month", "product_view_sessions",
        F.when(F.col("month").isNotNull() & (F.col("_has_carts") > 0),
               F.col("add_to_cart_sessions")).alias("add_to_cart_sessions"))
    buyers = (m.items_with_month(m.fact_order_items_completed)
              .groupBy("month").agg(F.countDistinct("user_id").alias("purchasing_users")))
    return _rates(stages.join(buyers, "month", "left").select(
        "month", "product_view_sessions", "add_to_cart_sessions", "purchasing_users"))


@shared
def agg_daily_funnel(m: Model) -> DataFrame:
    """Per event date, all three stages from the events: view and cart sessions,
    purchasing users."""
    ev = m.fact_events_all
    id_of_stage = F.when(F.col("event_type") == PURCHASE, F.col("user_id").cast("string")) \
                   .otherwise(F.col("session_id"))
    daily = _stage_distincts(ev, "event_date", id_of_stage).groupBy("event_date").agg(
        _count_stage(PRODUCT_VIEW).alias("product_view_sessions"),
        _count_stage(CART).alias("add_to_cart_sessions"),
        _count_stage(PURCHASE).alias("purchasing_users"))
    return _rates(daily)


def agg_monthly_funnel(m: Model) -> DataFrame:
    """A42 summed to months - sums of daily distinct counts, as the statement does."""
    daily = agg_daily_funnel(m)
    monthly = daily.groupBy(month_start(F.col("event_date")).alias("month")).agg(
        F.sum("product_view_sessions").alias("product_view_sessions"),
        F.sum("add_to_cart_sessions").alias("add_to_cart_sessions"),
        F.sum("purchasing_users").alias("purchasing_users"))
    return _rates(monthly)


def funnel_dropoff(m: Model) -> DataFrame:
    """Users lost between stages and the drop-off share (1 - conversion)."""
    f5 = agg_funnel_metrics(m)
    return f5.select(
        "month", "product_view_sessions", "add_to_cart_sessions", "purchasing_users",
        (F.col("product_view_sessions") - F.col("add_to_cart_sessions")).alias("lost_before_cart"),
        (F.col("add_to_cart_sessions") - F.col("purchasing_users")).alias("lost_before_purchase"),
        (1 - F.col("view_to_cart_rate")).alias("view_to_cart_dropoff"),
        (1 - F.col("cart_to_purchase_rate")).alias("cart_to_purchase_dropoff"),
        (1 - F.col("view_to_purchase_rate")).alias("view_to_purchase_dropoff"),
    )


def conversion_trend(m: Model) -> DataFrame:
    """Change of each F5 rate against the previous month row."""
    f5 = agg_funnel_metrics(m)
    by_month = Window.orderBy("month")
    cols = ["view_to_cart_rate", "cart_to_purchase_rate", "view_to_purchase_rate"]
    return f5.select(
        "month", *cols,
        *[(F.col(c) - F.lag(c).over(by_month)).alias(f"{c}_change") for c in cols])
