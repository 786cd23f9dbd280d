"""Product, brand and category tables.

Where every measure is additive (item counts, revenue sums), items are aggregated per
product before they meet the product table: the join then sees one row per product
instead of one per item, and a hot product is collapsed by the map-side partial
aggregate.  Measures with distinct users join first and aggregate once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.joins import spread_left_join
from tillroll.functions.metrics import (
    CANCELLED,
    COMPLETE,
    RETURNED,
    StatusPolicy,
    round_ratio,
    safe_divide,
    status_in_policy,
)
from tillroll.operators.geography import _country_kpis, _user_product_revenue
from tillroll.plans.model import Model


def _per_product_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("status") == CANCELLED).alias("n_cancelled"),
        F.count_if(F.col("status") != CANCELLED).alias("n_not_cancelled"))


def category_purchase_intensity(m: Model) -> DataFrame:
    """fact_order_items JOIN dim_product by category."""
    j = m.fact_order_items.join(m.dim_product, "product_id", "inner")
    g = j.groupBy("product_category").agg(
        F.countDistinct("user_id").alias("purchasing_users"),
        F.count(F.lit(1)).alias("total_items_sold"),
        F.sum("revenue").alias("total_revenue"))
    return g.select("product_category", "purchasing_users", "total_items_sold", "total_revenue",
                    round_ratio(F.col("total_items_sold"), F.col("purchasing_users"), 2).alias(
                        "items_per_user")).orderBy(F.col("total_revenue").desc())


def _cancellation_by(m: Model, keys: list[str], products: DataFrame) -> DataFrame:
    per_product = _per_product_counts(m.order_items)
    j = per_product.join(products, "product_id", "inner")
    return j.groupBy(*keys).agg(
        F.sum("n_items").alias("total_items"),
        F.sum("n_cancelled").alias("cancelled_items"),
        F.sum("n_not_cancelled").alias("_not_cancelled"))


def _raw_products(m: Model) -> DataFrame:
    return m.products.withColumnRenamed("id", "product_id")


def category_cancellation_variance(m: Model) -> DataFrame:
    """Raw items JOIN raw products by category."""
    g = _cancellation_by(m, ["category"], _raw_products(m))
    return g.select(F.col("category").alias("product_category"), "total_items",
                    "cancelled_items",
                    safe_divide(F.col("cancelled_items"), F.col("total_items")).alias(
                        "cancellation_rate")).orderBy(F.col("cancellation_rate").desc())


def product_cancellation(m: Model, min_items: int | None = None) -> DataFrame:
    """By category and product name; the statement's HAVING is commented out, so
    ``min_items`` defaults to None (no filter)."""
    g = _cancellation_by(m, ["category", "name"], _raw_products(m))
    if min_items is not None:
        g = g.filter(F.col("total_items") > min_items)
    return g.select("category", "name", "total_items", "cancelled_items",
                    safe_divide(F.col("cancelled_items"), F.col("total_items")).alias(
                        "cancellation_rate")).orderBy(F.col("cancellation_rate").desc())


def price_vs_cancellation(m: Model) -> DataFrame:
    """Item-weighted mean retail price and item cancellation rate by category."""
    per_product = _per_product_counts(m.order_items)
    j = per_product.join(_raw_products(m), "product_id", "inner")
    g = j.groupBy("category").agg(
        F.sum(F.col("retail_price") * F.col("n_items")).alias("_price_sum"),
        F.sum(F.when(F.col("retail_price").isNotNull(), F.col("n_items"))).alias("_priced"),
        F.sum("n_items").alias("_items"),
        F.sum("n_cancelled").alias("_cancelled"))
    return g.select("category",
                    safe_divide(F.col("_price_sum"), F.col("_priced")).alias("avg_price"),
                    safe_divide(F.col("_cancelled"), F.col("_items")).alias("cancellation_rate")
                    ).orderBy(F.col("avg_price").desc())


def hero_products(m: Model) -> DataFrame:
    """Complete-only revenue and distinct buyers by category and name, ranked."""
    items = m.order_items.filter(status_in_policy(F.col("status"), StatusPolicy.COMPLETE))
    j = items.join(_raw_products(m), "product_id", "inner")
    return j.groupBy("category", "name").agg(
        F.sum("sale_price").alias("revenue"),
        F.countDistinct("user_id").alias("unique_buyers")).orderBy(F.col("revenue").desc())


def product_performance_summary(m: Model) -> DataFrame:
    """By category, name and retail price."""
    complete = F.col("status") == COMPLETE
    j = m.order_items.join(_raw_products(m), "product_id", "inner")
    g = j.groupBy(F.col("category").alias("product_category"),
                  F.col("name").alias("product_name"), "retail_price").agg(
        F.count(F.lit(1)).alias("total_order_items"),
        F.count_if(complete).alias("completed_items"),
        F.count_if(F.col("status") == CANCELLED).alias("cancelled_items"),
        F.sum(F.when(complete, F.col("sale_price")).otherwise(F.lit(0))).alias("total_revenue"),
        F.countDistinct(F.when(complete, F.col("user_id"))).alias("unique_buyers"))
    return g.select(
        "*",
        safe_divide(F.col("cancelled_items"), F.col("total_order_items")).alias(
            "cancellation_rate"),
        safe_divide(F.col("total_revenue"), F.col("unique_buyers")).alias("revenue_per_buyer"),
        safe_divide(F.col("completed_items"), F.col("unique_buyers")).alias("items_per_buyer"))


def category_cancellation_risk(m: Model) -> DataFrame:
    """Raw items JOIN dim_product; 'completed_items' counts every non-cancelled
    status, as the statement does."""
    g = _cancellation_by(m, ["product_category"], m.dim_product)
    return g.select("product_category",
                    F.col("total_items").alias("total_order_items"), "cancelled_items",
                    F.col("_not_cancelled").alias("completed_items"),
                    safe_divide(F.col("cancelled_items"), F.col("total_items")).alias(
                        "cancellation_rate")).orderBy(F.col("cancellation_rate").desc())


def brand_performance_summary(m: Model) -> DataFrame:
    """By brand; return_rate = returned / (complete + returned)."""
    complete = F.col("status") == COMPLETE
    j = m.order_items.join(m.dim_product, "product_id", "inner")
    g = j.groupBy("brand").agg(
        F.count(F.lit(1)).alias("total_order_items"),
        F.count_if(complete).alias("completed_items"),
        F.count_if(F.col("status") == CANCELLED).alias("cancelled_items"),
        F.count_if(F.col("status") == RETURNED).alias("returned_items"),
        F.sum(F.when(complete, F.col("sale_price")).otherwise(F.lit(0))).alias("total_revenue"),
        F.countDistinct(F.when(complete, F.col("user_id"))).alias("unique_buyers"),
        F.min(F.when(complete, F.col("created_at"))).alias("first_sale_date"),
        F.max(F.when(complete, F.col("created_at"))).alias("last_sale_date"))
    return g.select(
        "*",
        safe_divide(F.col("cancelled_items"), F.col("total_order_items")).alias(
            "cancellation_rate"),
        safe_divide(F.col("returned_items"),
                    F.col("completed_items") + F.col("returned_items")).alias("return_rate"),
        safe_divide(F.col("total_revenue"), F.col("unique_buyers")).alias("revenue_per_buyer"),
    ).orderBy(F.col("total_revenue").desc())


def aggregate_category_kpis(m: Model) -> DataFrame:
    """As A37 by raw product category (NULL for unknown products); the revenue per
    user numerator drops items without a user."""
    base = spread_left_join(m.order_items, _raw_products(m).select("product_id", "category"), "product_id",
                            m.hot_keys("product_id"), ["order_id", "user_id", "created_at", "sale_price"])
    return _country_kpis(base, "category", user_filtered_revenue=True)


def revenue_by_category(m: Model) -> DataFrame:
    """fact_orders JOIN items JOIN dim_product."""
    j = _user_product_revenue(m).join(m.dim_product, "product_id", "inner")
    g = j.groupBy("product_category").agg(
        F.countDistinct("fo_user_id").alias("users"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("n_revenue").alias("_n"))
    return g.select("product_category", "users", "total_revenue",
                    safe_divide(F.col("total_revenue"), F.col("_n")).alias("avg_order_value")
                    ).orderBy(F.col("total_revenue").desc())


def month_category_revenue(m: Model) -> DataFrame:
    """Valid revenue by calendar month number (years pooled) and category."""
    items = m.order_items.filter(status_in_policy(F.col("status"), StatusPolicy.VALID))
    per_product = items.groupBy(
        "product_id", F.month("created_at").cast("bigint").alias("month")).agg(
        F.sum("sale_price").alias("revenue"))
    j = per_product.join(_raw_products(m), "product_id", "inner")
    return j.groupBy("month", "category").agg(F.sum("revenue").alias("revenue")).orderBy(
        "month", F.col("revenue").desc())
