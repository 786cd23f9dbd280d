"""Page 1: category portfolio (F4) and the portfolio measures built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.joins import spread_left_join
from tillroll.functions.metrics import (
    CANCELLED,
    MEAN_DIGITS,
    StatusPolicy,
    cents,
    count_flagged,
    exact_mean,
    join_groups,
    quotient,
    safe_divide,
    status_in_policy,
)
from tillroll.plans.model import Model, shared


@shared
def category_base(m: Model) -> DataFrame:
    """Per category (NULL for items whose product is unknown): distinct orders of every
    status, distinct cancelled orders, valid revenue (decimal), distinct valid buyers.

    The per-(order, user, product, status) pre-aggregate of the statement does not change
    any of these sums or distinct counts, so it is not repeated (a test pins the equality).
    """
    valid = status_in_policy(F.col("status"), StatusPolicy.VALID)
    items = spread_left_join(m.fact_order_items_all, m.dim_product.select("product_id", "product_category"), "product_id",
                             m.hot_keys("product_id"), ["order_id", "user_id", "order_date", "revenue"])
    by = ["product_category"]
    orders = count_flagged(items, by, "order_id", {
        "total_orders": F.lit(True), "cancelled_orders": F.col("status") == CANCELLED}, {
        "total_revenue": F.when(valid, F.col("revenue")).otherwise(F.lit(0))})
    buyers = count_flagged(items, by, "user_id", {"purchasing_users": valid})
    return join_groups(orders, buyers, by).select(
        *by, "total_orders", "cancelled_orders", F.col("total_revenue").cast("decimal(22,2)").alias("total_revenue"),
        "purchasing_users")


def final_category_performance(m: Model) -> DataFrame:
    """F4.  Company totals come from a grand-total window over the per-category rows (one
    row per category, so the single window partition is as small as the category list)."""
    cb = category_base(m)
    everything = Window.partitionBy()
    cb = (cb.withColumn("company_revenue", F.sum("total_revenue").over(everything))
            .withColumn("company_orders", F.sum("total_orders").over(everything)))
    return cb.select(
        "product_category", "total_orders", "cancelled_orders", "total_revenue",
        "purchasing_users",
        safe_divide(F.col("total_revenue"), F.col("total_orders")).alias("AOV"),
        safe_divide(F.col("total_revenue"), F.col("purchasing_users")).alias("revenue_per_user"),
        safe_divide(F.col("cancelled_orders"), F.col("total_orders")).alias("cancellation_rate"),
        safe_divide(F.col("total_revenue"), F.col("company_revenue")).alias("revenue_share"),
        safe_divide(F.col("total_orders"), F.col("company_orders")).alias("order_share"),
    )


def category_segments(m: Model) -> DataFrame:
    """Premium when AOV >= the mean category AOV, volume when orders >= mean orders."""
    f4 = final_category_performance(m)
    everything = Window.partitionBy()
    aov = quotient(cents(F.col("total_revenue")), F.col("total_orders") * 100)
    f4 = (f4.withColumn("_aov", aov).withColumn("mean_aov", exact_mean(F.col("_aov"), lambda c: c.over(everything)))
            .withColumn("all_orders", F.sum("total_orders").over(everything))
            .withColumn("categories", F.count("total_orders").over(everything)))
    premium = F.col("_aov") >= F.col("mean_aov")
    volume = F.col("total_orders") * F.col("categories") >= F.col("all_orders")
    return f4.select(
        "product_category", "AOV", "total_orders",
        F.coalesce(premium, F.lit(False)).alias("is_premium"),
        F.coalesce(volume, F.lit(False)).alias("is_volume"),
        # Segment labels.
        F.when(premium & volume, "premium volume")
         .when(premium, "premium")
         .when(volume, "volume")
         .otherwise("niche").alias("segment"),
    )


def portfolio_concentration(m: Model) -> DataFrame:
    """Rank by revenue share, cumulative share, Herfindahl index (sum of squared
    shares).  The cumulative share is a running decimal sum over the company total, so it
    is exact; the index is a double sum, reported to MEAN_DIGITS decimals."""
    cb = category_base(m)
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("total_revenue").desc(),
                            F.col("product_category").asc_nulls_first())
    running = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cb = cb.withColumn("company_revenue", F.sum("total_revenue").over(everything))
    share = safe_divide(F.col("total_revenue"), F.col("company_revenue"))
    return cb.select(
        "product_category",
        share.alias("revenue_share"),
        F.row_number().over(ranked).alias("share_rank"),
        safe_divide(F.sum("total_revenue").over(running), F.col("company_revenue")).alias(
            "cumulative_share"),
        F.round(F.sum(share * share).over(everything), MEAN_DIGITS).alias("hhi"),
    )


def portfolio_headline(m: Model) -> DataFrame:
    """One row over all items: valid revenue, distinct orders (all and valid), AOV
    over valid orders, and the share of orders with a cancelled item."""
    valid = status_in_policy(F.col("status"), StatusPolicy.VALID)
    agg = count_flagged(m.fact_order_items_all, [], "order_id", {
        "total_orders": F.lit(True), "valid_orders": valid, "cancelled_orders": F.col("status") == CANCELLED}, {
        "total_revenue": F.when(valid, F.col("revenue")).otherwise(F.lit(0))})
    return agg.select(
        "total_revenue", "total_orders", "valid_orders", "cancelled_orders",
        safe_divide(F.col("total_revenue"), F.col("valid_orders")).alias("avg_order_value"),
        safe_divide(F.col("cancelled_orders"), F.col("total_orders")).alias("cancellation_rate"),
    )
