"""Seasonality reports over the monthly growth series (A55-A62) and the country x month
series they need (decision D4).

Input rows are months (or country x months), so every aggregate and window here works on
a table bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.joins import spread_left_join
from tillroll.functions.metrics import cents, exact_mean, pct_2dp, quotient, safe_divide
from tillroll.operators.growth import agg_monthly_kpis_enriched, enrich_monthly, monthly_kpis
from tillroll.plans.model import Model, shared

# The year window and the countries of the seasonality statements.
SEASON_YEARS = (2020, 2025)
SEASON_COUNTRIES = ("United States", "China", "Brazil")


def _yr(c: str = "month") -> F.Column:
    return F.year(c).cast("bigint")


def _mon(c: str = "month") -> F.Column:
    return F.month(c).cast("bigint")


def _in_years(c: str = "month") -> F.Column:
    return _yr(c).between(*SEASON_YEARS)


def _with_mom(f7: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """F7 with its two MoM changes as exact quotients, ``_rev`` and ``_ord``."""
    order = Window.partitionBy(*keys).orderBy("month")
    revenue, orders = cents(F.col("total_revenue")), F.col("total_orders")
    for name, x in (("_rev", revenue), ("_ord", orders)):
        before = F.lag(x).over(order)
        f7 = f7.withColumn(name, quotient(x - before, before))
    return f7


def _means(g) -> DataFrame:
    return g.agg(exact_mean(F.col("_rev")).alias("_r"), exact_mean(F.col("_ord")).alias("_o"))


def seasonality_by_month_number(m: Model) -> DataFrame:
    """Mean MoM x 100 (2 dp) by month number."""
    f7 = _with_mom(agg_monthly_kpis_enriched(m))
    g = _means(f7.groupBy(_mon().alias("month_number")))
    return g.select("month_number", pct_2dp(F.col("_r")).alias("avg_revenue_mom_pct"),
                    pct_2dp(F.col("_o")).alias("avg_orders_mom_pct")
                    ).orderBy("month_number")


def seasonality_by_year_month(m: Model) -> DataFrame:
    """A56."""
    f7 = _with_mom(agg_monthly_kpis_enriched(m))
    g = _means(f7.groupBy(_yr().alias("year"), _mon().alias("month_number")))
    return g.select("year", "month_number", pct_2dp(F.col("_r")).alias("rev_mom"),
                    pct_2dp(F.col("_o")).alias("order_mom")
                    ).orderBy("year", "month_number")


def seasonality_by_month_name(m: Model) -> DataFrame:
    """By month label 'Jan'..'Dec', in calendar order (decision D5)."""
    f7 = _with_mom(agg_monthly_kpis_enriched(m))
    g = f7.groupBy(F.date_format("month", "MMM").alias("month_label")).agg(
        exact_mean(F.col("_rev")).alias("_r"), exact_mean(F.col("_ord")).alias("_o"),
        F.min(_mon()).alias("_n"))
    return g.orderBy("_n").select(
        F.col("month_label").alias("month"),
        pct_2dp(F.col("_r")).alias("avg_revenue_mom_pct"),
        pct_2dp(F.col("_o")).alias("avg_orders_mom_pct"))


def seasonality_2020_2025(m: Model) -> DataFrame:
    """Mean MoM as a fraction (2 dp) by month number over 2020-2025 (decision D5)."""
    f7 = _with_mom(agg_monthly_kpis_enriched(m)).filter(_in_years())
    g = _means(f7.groupBy(_mon().alias("month")))
    return g.select("month", pct_2dp(F.col("_r"), 1).alias("avg_rev_mom"),
                    pct_2dp(F.col("_o"), 1).alias("avg_orders_mom")).orderBy("month")


def seasonality_sign_counts(m: Model) -> DataFrame:
    """Rises, falls and means of MoM by month number, 2020-2025, both MoM known."""
    f7 = _with_mom(agg_monthly_kpis_enriched(m)).filter(
        F.col("revenue_mom_pct").isNotNull() & F.col("orders_mom_pct").isNotNull() & _in_years())
    rev, ord_ = F.col("revenue_mom_pct"), F.col("orders_mom_pct")
    one, zero = F.lit(1), F.lit(0)
    return f7.groupBy(_mon().alias("mon")).agg(
        F.count(F.lit(1)).alias("year_month_points"),
        F.sum(F.when(rev > 0, one).otherwise(zero)).cast("bigint").alias("rev_pos_count"),
        F.sum(F.when(rev < 0, one).otherwise(zero)).cast("bigint").alias("rev_neg_count"),
        exact_mean(F.col("_rev")).cast("double").alias("avg_rev_mom"),
        F.sum(F.when(ord_ > 0, one).otherwise(zero)).cast("bigint").alias("ord_pos_count"),
        F.sum(F.when(ord_ < 0, one).otherwise(zero)).cast("bigint").alias("ord_neg_count"),
        exact_mean(F.col("_ord")).cast("double").alias("avg_ord_mom")).orderBy("mon")


def inspect_year(m: Model, year: int) -> DataFrame:
    """The MoM rows of one year (the statement's 2026 is past the test data)."""
    f7 = agg_monthly_kpis_enriched(m).filter(_yr() == year)
    return f7.orderBy("month").select(_yr().alias("yr"), _mon().alias("mon"),
                                      "revenue_mom_pct", "orders_mom_pct")


def mom_recompute_check(m: Model) -> DataFrame:
    """MoM recomputed from LAG columns of F7, first row dropped."""
    f7 = agg_monthly_kpis_enriched(m)
    order = Window.orderBy("month")
    x = f7.select("month", "total_revenue", "total_orders",
                  F.lag("total_revenue").over(order).alias("prev_rev"),
                  F.lag("total_orders").over(order).alias("prev_ord"))
    return x.filter(F.col("prev_rev").isNotNull()).select(
        "month",
        safe_divide(F.col("total_revenue") - F.col("prev_rev"), F.col("prev_rev")).alias(
            "rev_mom_calc"),
        safe_divide(F.col("total_orders") - F.col("prev_ord"), F.col("prev_ord")).alias(
            "ord_mom_calc")).orderBy("month")


@shared
def country_month_kpis(m: Model) -> DataFrame:
    """F6/F7 columns by (country, month); country from dim_user (NULL for items of an
    unknown user); MoM against the previous month of the same country."""
    items = spread_left_join(m.items_with_month(), m.dim_user.select("user_id", "country"), "user_id",
                             m.hot_keys("user_id"), ["order_id", "product_id", "order_date", "revenue"])
    return enrich_monthly(monthly_kpis(items, ["country"]), ["country"])


def seasonality_by_country(m: Model) -> DataFrame:
    """Mean MoM and points by country and month number for three countries,
    2020-2025, revenue MoM known."""
    c = _with_mom(country_month_kpis(m), ("country",)).filter(
        F.col("revenue_mom_pct").isNotNull() & _in_years()
        & F.col("country").isin(*SEASON_COUNTRIES))
    return c.groupBy("country", _mon().alias("mon")).agg(
        exact_mean(F.col("_rev")).cast("double").alias("avg_rev_mom"),
        exact_mean(F.col("_ord")).cast("double").alias("avg_ord_mom"),
        F.count(F.lit(1)).alias("points")).orderBy("country", "mon")
