"""Page 3: growth series (F6-F9), the monthly revenue reports (A31-A36) and the growth
measures (R1, R2, R5, R6, R9).

The monthly and yearly series have one row per calendar period, so their total-order
windows (LAG over month or year) run on a table bounded by the calendar, not the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.metrics import (
    CANCELLED,
    MEAN_DIGITS,
    MONEY_MEAN_DIGITS,
    StatusPolicy,
    count_flagged,
    join_groups,
    round_ratio,
    safe_divide,
    status_in_policy,
)
from tillroll.plans.model import Model, shared


def _pct_change(col: str, order: Window) -> F.Column:
    prev = F.lag(col).over(order)
    return safe_divide(F.col(col) - prev, prev)


def monthly_kpis(df: DataFrame, keys: list[str]) -> DataFrame:
    """F6 over F1-shaped rows with a ``month`` column, grouped by ``keys`` + month.

    Items are reduced per order and per buyer (``count_flagged``), which gives the statement's
    two monthly aggregates together: rows of months without a valid item are dropped (the statement left-joins from
    the valid-revenue months) and a NULL month keeps NULL all-order columns, since NULL
    never matches in that join.
    """
    valid = status_in_policy(F.col("status"), StatusPolicy.VALID)
    cancelled = F.col("status") == CANCELLED
    by = [*keys, "month"]
    orders = count_flagged(df, by, "order_id", {
        "total_orders": valid, "_orders_all": F.lit(True), "_cancelled_orders": cancelled}, {
        "_valid_items": valid.cast("int"), "total_revenue": F.when(valid, F.col("revenue")),
        "_cancelled_rev": F.when(cancelled, F.col("revenue")).otherwise(F.lit(0))})
    buyers = count_flagged(df.filter(valid), by, "user_id", {"purchasing_users": F.lit(True)})
    g = join_groups(orders.filter(F.col("_valid_items") > 0), buyers, by)
    money = "decimal(22,2)"
    g = g.withColumns({c: F.col(c).cast(money) for c in ("total_revenue", "_cancelled_rev")})
    known = F.col("month").isNotNull()
    return g.select(
        *keys, "month", "total_revenue", "total_orders", "purchasing_users",
        safe_divide(F.col("total_revenue"), F.col("total_orders")).alias("avg_order_value"),
        safe_divide(F.col("total_revenue"), F.col("purchasing_users")).alias("revenue_per_user"),
        F.when(known, F.col("_orders_all")).alias("total_orders_all"),
        F.when(known, F.col("_cancelled_orders")).alias("cancelled_orders"),
        F.when(known, safe_divide(F.col("_cancelled_orders"), F.col("_orders_all"))).alias(
            "cancellation_rate"),
        F.when(known, F.col("_cancelled_rev")).alias("cancelled_revenue"),
    )


@shared
def agg_monthly_kpis(m: Model) -> DataFrame:
    """F6 (with cancelled_revenue, decision D3)."""
    return monthly_kpis(m.items_with_month(), [])


def enrich_monthly(f6: DataFrame, keys: list[str]) -> DataFrame:
    """F7 columns: MoM change of revenue and orders against the previous row."""
    order = Window.partitionBy(*keys).orderBy("month") if keys else Window.orderBy("month")
    return f6.select(
        *keys, "month", "total_revenue", "total_orders", "purchasing_users",
        "revenue_per_user", "cancellation_rate", "cancelled_revenue",
        _pct_change("total_revenue", order).alias("revenue_mom_pct"),
        _pct_change("total_orders", order).alias("orders_mom_pct"),
    )


@shared
def agg_monthly_kpis_enriched(m: Model) -> DataFrame:
    """F7."""
    return enrich_monthly(agg_monthly_kpis(m), [])


def agg_yearly_kpis(m: Model) -> DataFrame:
    """F8: F6 by year; orders are the sum of monthly distinct orders."""
    f6 = agg_monthly_kpis(m)
    return f6.groupBy(F.year("month").cast("bigint").alias("year")).agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("total_orders").alias("total_orders"))


def agg_yearly_kpis_enriched(m: Model) -> DataFrame:
    """F9."""
    f8 = agg_yearly_kpis(m)
    order = Window.orderBy("year")
    return f8.select(
        "year", "total_revenue", "total_orders",
        _pct_change("total_revenue", order).alias("revenue_yoy_pct"),
        _pct_change("total_orders", order).alias("orders_yoy_pct"))


# Monthly reports over raw order items --------------------------------------

def _not_cancelled_by_month(m: Model) -> DataFrame:
    return m.raw_items_with_month().filter(
        status_in_policy(F.col("status"), StatusPolicy.NOT_CANCELLED))


def monthly_revenue_global(m: Model) -> DataFrame:
    """A31."""
    return _not_cancelled_by_month(m).groupBy("month").agg(
        F.sum("sale_price").alias("total_revenue"),
        F.countDistinct("order_id").alias("total_orders")).orderBy("month")


def monthly_purchasing_users(m: Model) -> DataFrame:
    """A32."""
    return (_not_cancelled_by_month(m).filter(F.col("user_id").isNotNull())
            .groupBy("month").agg(F.countDistinct("user_id").alias("purchasing_users"))
            .orderBy("month"))


def monthly_cancellation_rate(m: Model) -> DataFrame:
    """Cancelled items over all items (plain division; every group has a row)."""
    return m.raw_items_with_month().groupBy("month").agg(
        (F.count(F.when(F.col("status") == CANCELLED, F.lit(1))) / F.count(F.lit(1))).alias(
            "cancellation_rate")).orderBy("month")


def monthly_cancelled_revenue(m: Model) -> DataFrame:
    """A34."""
    return m.raw_items_with_month().groupBy("month").agg(
        F.sum(F.when(F.col("status") == CANCELLED, F.col("sale_price")).otherwise(F.lit(0)))
        .alias("cancelled_revenue")).orderBy("month")


def monthly_revenue_per_order(m: Model) -> DataFrame:
    """A35."""
    g = _not_cancelled_by_month(m).groupBy("month").agg(
        F.sum("sale_price").alias("total_revenue"),
        F.countDistinct("order_id").alias("total_orders"))
    return g.select("month", "total_revenue", "total_orders",
                    round_ratio(F.col("total_revenue"), F.col("total_orders"), 2, money=True)
                    .alias("revenue_per_order")).orderBy("month")


def monthly_revenue_per_user(m: Model) -> DataFrame:
    """A36."""
    g = _not_cancelled_by_month(m).groupBy("month").agg(
        F.sum("sale_price").alias("total_revenue"),
        F.countDistinct("user_id").alias("purchasing_users"))
    return g.select("month", "total_revenue", "purchasing_users",
                    round_ratio(F.col("total_revenue"), F.col("purchasing_users"), 2, money=True)
                    .alias("revenue_per_user")).orderBy("month")


# Growth measures ---------------------------------------------------------------------

def _full_years(m: Model) -> DataFrame:
    """F8 restricted to years with twelve months of valid sales."""
    f6 = agg_monthly_kpis(m).filter(F.col("month").isNotNull())
    return f6.groupBy(F.year("month").cast("bigint").alias("year")).agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.count(F.lit(1)).alias("months")).filter(F.col("months") == 12)


def growth_multiple(m: Model) -> DataFrame:
    """R2: last full year's revenue over the first full year's."""
    fy = _full_years(m)
    ends = fy.agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.min_by("total_revenue", "year").alias("first_revenue"),
        F.max_by("total_revenue", "year").alias("last_revenue"))
    return ends.select(
        "first_year", "last_year", "first_revenue", "last_revenue",
        safe_divide(F.col("last_revenue"), F.col("first_revenue")).alias("growth_multiple"))


def cagr(m: Model) -> DataFrame:
    """(V_last / V_first) ^ (1 / (y_last - y_first)) - 1 over full years."""
    g = growth_multiple(m)
    span = F.col("last_year") - F.col("first_year")
    rate = F.when(span > 0, F.pow(F.col("growth_multiple"), 1.0 / span.cast("double")) - 1)
    return g.select("first_year", "last_year", "first_revenue", "last_revenue",
                    span.alias("years"), F.round(rate, MEAN_DIGITS).alias("cagr"))


def growth_pattern(m: Model) -> DataFrame:
    """Yearly revenue multiple labelled triple (>=3), double (>=2), growth (>=1),
    decline (<1); the first year has no label."""
    f8 = agg_yearly_kpis(m)
    prev = F.lag("total_revenue").over(Window.orderBy("year"))
    mult = safe_divide(F.col("total_revenue"), prev)
    g = f8.select("year", "total_revenue", mult.alias("growth_multiple"))
    # Pattern labels and thresholds.
    label = (F.when(F.col("growth_multiple") >= 3, "triple")
             .when(F.col("growth_multiple") >= 2, "double")
             .when(F.col("growth_multiple") >= 1, "growth")
             .when(F.col("growth_multiple") < 1, "decline"))
    return g.select("*", label.alias("growth_pattern"))


def revenue_decomposition(m: Model) -> DataFrame:
    """Yearly revenue = buyers x orders per buyer x AOV, with the share of each
    factor in the log change of revenue against the previous year."""
    f2 = m.fact_order_items_completed
    f2 = f2.withColumn("year", F.year("order_date").cast("bigint"))
    y = join_groups(
        count_flagged(f2, ["year"], "order_id", {"orders": F.lit(True)}, {"total_revenue": F.col("revenue")}),
        count_flagged(f2, ["year"], "user_id", {"buyers": F.lit(True)}), ["year"])
    y = y.withColumn("total_revenue", F.col("total_revenue").cast("decimal(22,2)"))
    y = y.select("year", "total_revenue", "buyers", "orders",
                 safe_divide(F.col("orders"), F.col("buyers")).alias("orders_per_buyer"),
                 safe_divide(F.col("total_revenue"), F.col("orders")).alias("avg_order_value"))
    order = Window.orderBy("year")

    def dlog(c: str) -> F.Column:
        return F.ln(F.col(c).cast("double")) - F.ln(F.lag(F.col(c).cast("double")).over(order))

    out = y.select("*", dlog("total_revenue").alias("_dr"), dlog("buyers").alias("_db"),
                   dlog("orders_per_buyer").alias("_df"), dlog("avg_order_value").alias("_da"))
    def share(c: str) -> F.Column:
        return F.round(F.try_divide(F.col(c), F.col("_dr")), MEAN_DIGITS)

    return out.select("year", "total_revenue", "buyers", "orders", "orders_per_buyer",
                      "avg_order_value", share("_db").alias("buyers_log_share"),
                      share("_df").alias("frequency_log_share"),
                      share("_da").alias("aov_log_share"))


def revenue_per_user_stability(m: Model) -> DataFrame:
    """Spread of monthly revenue per user within each year (std / mean)."""
    f6 = agg_monthly_kpis(m).filter(F.col("month").isNotNull())
    g = f6.groupBy(F.year("month").cast("bigint").alias("year")).agg(
        F.count(F.lit(1)).alias("months"),
        F.avg("revenue_per_user").alias("_mean"),
        F.stddev_pop("revenue_per_user").alias("_std"))
    return g.select("year", "months",
                    F.round("_mean", MONEY_MEAN_DIGITS).alias("mean_revenue_per_user"),
                    F.round("_std", MONEY_MEAN_DIGITS).alias("std_revenue_per_user"),
                    F.round(F.try_divide(F.col("_std"), F.col("_mean")), MEAN_DIGITS).alias(
                        "coefficient_of_variation"))
