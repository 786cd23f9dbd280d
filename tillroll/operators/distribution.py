"""Revenue distribution across users (A51, A52, A54): per-user totals, then their spread.

Both levels are hash aggregates; the per-user level absorbs a heavy user map-side, and
the second level sees one row per user (or per user and category).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import safe_divide
from tillroll.operators.geography import _user_product_revenue, _user_revenue
from tillroll.plans.model import Model


def _mean(total: str, n: str) -> F.Column:
    return safe_divide(F.col(total), F.col(n))


def user_revenue_distribution(m: Model) -> DataFrame:
    """Revenue per fact_orders user (a NULL user is one group), then min/max/avg."""
    per_user = _user_revenue(m).withColumnRenamed("revenue", "rev")
    g = per_user.agg(F.min("rev").alias("min_revenue"), F.max("rev").alias("max_revenue"),
                     F.sum("rev").alias("_s"), F.count("rev").alias("_n"))
    return g.select("min_revenue", "max_revenue", _mean("_s", "_n").alias("avg_revenue"))


def user_revenue_by_country(m: Model) -> DataFrame:
    """A52."""
    du = m.dim_user.select(F.col("user_id").alias("fo_user_id"), "country")
    per_user = (_user_revenue(m).join(du, "fo_user_id", "inner")
                .groupBy("fo_user_id", "country").agg(F.sum("revenue").alias("rev")))
    g = per_user.groupBy("country").agg(
        F.count(F.lit(1)).alias("users"), F.min("rev").alias("min_revenue"),
        F.sum("rev").alias("_s"), F.count("rev").alias("_n"), F.max("rev").alias("max_revenue"))
    return g.select("country", "users", "min_revenue", _mean("_s", "_n").alias("avg_revenue"),
                    "max_revenue").orderBy(F.col("avg_revenue").desc())


def category_user_skew(m: Model) -> DataFrame:
    """Revenue per (category, user), then users, mean and max by category."""
    per_user = (_user_product_revenue(m).join(m.dim_product, "product_id", "inner")
                .groupBy("product_category", "fo_user_id").agg(F.sum("revenue").alias("rev")))
    g = per_user.groupBy("product_category").agg(
        F.count(F.lit(1)).alias("users"), F.sum("rev").alias("_s"), F.count("rev").alias("_n"),
        F.max("rev").alias("max_revenue"))
    return g.select("product_category", "users", _mean("_s", "_n").alias("avg_revenue"),
                    "max_revenue").orderBy(F.col("avg_revenue").desc())
