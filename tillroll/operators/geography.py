"""Country and demographic tables (A6, A7, A9-A12, A15-A17, A21, A37, A45-A50 and the
merged country table of decision D6).

Plan shape: order items and events are first aggregated per user (a map-side partial
aggregate absorbs a user holding a large share of the rows), and only the per-user rows
meet the user dimension.  Distinct users per country are counted as dimension rows that
have an event or item (a semi join), which is exact because user_id is the dimension key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.countries import COUNTRY_MAP_GERMANY_ONLY, COUNTRY_MAP_SPAIN_GERMANY
from tillroll.functions.joins import deal, spread_left_join
from tillroll.functions.metrics import (
    CANCELLED,
    StatusPolicy,
    count_flagged,
    exact_mean,
    join_groups,
    quotient,
    round_ratio,
    safe_divide,
    standardize_country,
    status_in_policy,
)
from tillroll.plans.model import CART, PRODUCT_VIEW, Model, shared

DEMOGRAPHICS = ["country", "age_group", "gender"]


def _items_per_user(items: DataFrame) -> DataFrame:
    return items.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("status") == CANCELLED).alias("n_cancelled"))


@shared
def country_cancellation_metrics(m: Model) -> DataFrame:
    """dim_user LEFT JOIN raw order items by country, age band, gender.  A user
    without items contributes one (empty) joined row, as COUNT(*) does in the statement."""
    per_user = _items_per_user(m.order_items)
    j = m.dim_user.join(per_user, "user_id", "left")
    g = j.groupBy(*DEMOGRAPHICS).agg(
        F.sum(F.coalesce(F.col("n_items"), F.lit(1))).alias("total_order_items"),
        F.sum(F.coalesce(F.col("n_cancelled"), F.lit(0))).alias("cancelled_items"))
    return g.select(*DEMOGRAPHICS, "total_order_items", "cancelled_items",
                    safe_divide(F.col("cancelled_items"), F.col("total_order_items")).alias(
                        "cancellation_rate"))


def country_browsing_metrics_v1(m: Model) -> DataFrame:
    """Identified product views (fact_events v1) by standardised country."""
    views = (m.fact_events_v1.filter(F.col("event_type") == PRODUCT_VIEW)
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    return (m.dim_user.join(views, "user_id", "inner")
            .groupBy("country").agg(F.sum("n").alias("product_views")))


def country_browsing_metrics_v2(m: Model) -> DataFrame:
    """Raw product events joined to raw users; country as stored, not standardised."""
    views = (m.events.filter(F.col("event_type") == PRODUCT_VIEW)
             .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    users = m.users.select(F.col("id").alias("user_id"), "country")
    return (users.join(views, "user_id", "inner")
            .groupBy("country").agg(F.sum("n").alias("product_views")))


def _user_countries(m: Model) -> DataFrame:
    """Distinct (user_id, country): a user listed twice counts once per country."""
    return m.dim_user.select("user_id", "country").distinct()


def country_cart_metrics(m: Model) -> DataFrame:
    """A10: distinct users with a cart event, by country."""
    # Deduplicated before the semi join: AQE can split only the left side of a semi join,
    # and the partial aggregate of distinct() collapses a hot user map-side.
    carts = m.events.filter(F.col("event_type") == CART).select("user_id").distinct()
    return (_user_countries(m).join(carts, "user_id", "left_semi")
            .groupBy("country").agg(F.count(F.lit(1)).alias("cart_users")))


def country_purchase_users(m: Model) -> DataFrame:
    """Distinct users with a fact_order_items row, by country."""
    buyers = m.fact_order_items.select("user_id").distinct()
    return (_user_countries(m).join(buyers, "user_id", "left_semi")
            .groupBy("country").agg(F.count(F.lit(1)).alias("purchasing_users")))


@shared
def country_cart_purchase_funnel(m: Model) -> DataFrame:
    """A12."""
    c = country_cart_metrics(m)
    p = country_purchase_users(m)
    j = c.join(p, "country", "left").select(
        "country", "cart_users",
        F.coalesce(F.col("purchasing_users"), F.lit(0)).alias("purchasing_users"))
    return j.select(
        "*",
        safe_divide(F.col("purchasing_users"), F.col("cart_users")).alias(
            "cart_to_purchase_conversion"),
        round_ratio(F.col("purchasing_users") * 100, F.col("cart_users"), 2).alias(
            "cart_to_purchase_conversion_pct"))


def _not_cancelled_per_user(m: Model) -> DataFrame:
    items = m.order_items.filter(status_in_policy(F.col("status"), StatusPolicy.NOT_CANCELLED))
    return items.groupBy("user_id").agg(
        F.sum("sale_price").alias("revenue"), F.count(F.lit(1)).alias("n_items"))


@shared
def _country_revenue_base(m: Model) -> DataFrame:
    """Per country: not-cancelled revenue, distinct buyers, item count."""
    j = m.dim_user.join(_not_cancelled_per_user(m), "user_id", "inner")
    return j.groupBy("country").agg(
        F.sum("revenue").alias("total_revenue"),
        F.countDistinct("user_id").alias("purchasing_users"),
        F.sum("n_items").alias("total_order_items"))


def country_revenue(m: Model) -> DataFrame:
    """A15 (ROUND(SUM(decimal), 2) keeps the exact sum)."""
    return _country_revenue_base(m).orderBy(F.col("total_revenue").desc())


def revenue_share(m: Model) -> DataFrame:
    """Share of the grand total in percent, 2 dp.  Plain division: a zero grand total
    raises, as the statement does.  The window holds one row per country."""
    r = _country_revenue_base(m)
    grand = F.sum("total_revenue").over(Window.partitionBy())
    pct = F.round((F.col("total_revenue") * F.lit(100)) / grand, 2).cast("double")
    return r.select("country", "total_revenue", pct.alias("revenue_share_pct"))


def revenue_per_user(m: Model) -> DataFrame:
    """A17."""
    r = _country_revenue_base(m)
    return r.select("country", "total_revenue", "purchasing_users",
                    round_ratio(F.col("total_revenue"), F.col("purchasing_users"), 2, money=True)
                    .alias("revenue_per_user")).orderBy(F.col("revenue_per_user").desc())


@shared
def country_performance_summary(m: Model) -> DataFrame:
    """A15 LEFT JOIN A12 LEFT JOIN (mean of A6 rates by country)."""
    r = _country_revenue_base(m).select("country", "total_revenue", "purchasing_users")
    f = country_cart_purchase_funnel(m).select("country", "cart_to_purchase_conversion_pct")
    c = country_cancellation_metrics(m).groupBy("country").agg(
        exact_mean(quotient(F.col("cancelled_items"), F.col("total_order_items"))).cast("double").alias(
            "cancellation_rate"))
    return r.join(f, "country", "left").join(c, "country", "left").select(
        "country", "total_revenue", "purchasing_users", "cart_to_purchase_conversion_pct",
        "cancellation_rate")


def _country_kpis(base: DataFrame, key: str, user_filtered_revenue: bool) -> DataFrame:
    """A37/A38 body: not-cancelled revenue, orders, buyers; efficiency ratios; item
    cancellation rate at 4 dp; cancelled revenue.  NULL status counts in no class but
    in COUNT(*)."""
    nc = status_in_policy(F.col("status"), StatusPolicy.NOT_CANCELLED)
    cancelled = F.col("status") == CANCELLED
    known_user = F.col("user_id").isNotNull()
    zero = F.lit(0)
    one, price = F.lit(1), F.col("sale_price")
    orders = count_flagged(base, [key], "order_id", {"total_orders": nc}, {
        "total_revenue": F.when(nc, price).otherwise(zero),
        "_user_rev": F.when(nc & known_user, price).otherwise(zero),
        "_cancelled_items": F.when(cancelled, one).otherwise(zero), "_items": one,
        "cancelled_revenue": F.when(cancelled, price).otherwise(zero)})
    g = join_groups(orders, count_flagged(base, [key], "user_id", {"purchasing_users": nc}), [key])
    g = g.withColumns({c: F.col(c).cast("decimal(22,2)") for c in ("total_revenue", "_user_rev", "cancelled_revenue")})
    user_rev = F.col("_user_rev") if user_filtered_revenue else F.col("total_revenue")
    return g.select(
        key, "total_revenue", "total_orders", "purchasing_users",
        round_ratio(F.col("total_revenue"), F.col("total_orders"), 2, money=True).alias(
            "revenue_per_order"),
        round_ratio(user_rev, F.col("purchasing_users"), 2, money=True).alias("revenue_per_user"),
        round_ratio(F.col("_cancelled_items"), F.col("_items"), 4).alias("cancellation_rate"),
        "cancelled_revenue")


def agg_country_kpis(m: Model) -> DataFrame:
    """Raw items LEFT JOIN raw users; Spain and Germany spellings merged."""
    users = m.users.select(F.col("id").alias("user_id"), "country")
    base = spread_left_join(m.order_items, users, "user_id", m.hot_keys("user_id"),
                            ["order_id", "product_id", "created_at", "sale_price"]).select(
        standardize_country(F.col("country"), COUNTRY_MAP_SPAIN_GERMANY).alias("country"),
        "order_id", "user_id", "sale_price", "status")
    return _country_kpis(base, "country", user_filtered_revenue=False)


def _user_base(m: Model, mapping: dict | None) -> DataFrame:
    country = F.col("country") if mapping is None else standardize_country(F.col("country"),
                                                                           mapping)
    return m.dim_user.groupBy(country.alias("country")).agg(
        F.countDistinct("user_id").alias("total_users"))


def agg_country_user_base_v1(m: Model) -> DataFrame:
    """A45."""
    return _user_base(m, None)


def agg_country_user_base_v2(m: Model) -> DataFrame:
    """Deutschland counted as Germany."""
    return _user_base(m, COUNTRY_MAP_GERMANY_ONLY)


def _final_country(perf: DataFrame, base: DataFrame) -> DataFrame:
    return perf.join(base, "country", "left").select(
        "country", "total_users", "purchasing_users", "total_revenue",
        safe_divide(F.col("purchasing_users"), F.col("total_users")).alias("purchase_rate"),
        safe_divide(F.col("total_revenue"), F.col("purchasing_users")).alias("revenue_per_user"),
        "cart_to_purchase_conversion_pct", "cancellation_rate")


def final_country_performance_v1(m: Model) -> DataFrame:
    """A46."""
    return _final_country(country_performance_summary(m), _user_base(m, None))


def final_country_performance_v2(m: Model) -> DataFrame:
    """Deutschland renamed on both sides without re-aggregation, so Germany may
    appear twice (decision D6 keeps this; see final_country_performance_merged)."""
    perf = country_performance_summary(m).withColumn(
        "country", standardize_country(F.col("country"), COUNTRY_MAP_GERMANY_ONLY))
    return _final_country(perf, _user_base(m, COUNTRY_MAP_GERMANY_ONLY))


def final_country_performance_merged(m: Model) -> DataFrame:
    """One row per country after the Germany merge.  Additive counts are summed before
    the ratios: revenue and buyers (a user has one country), cart and buying users for the
    conversion, cancelled and total items for a pooled cancellation rate."""
    def merge(df: DataFrame) -> DataFrame:
        return df.withColumn(
            "country", standardize_country(F.col("country"), COUNTRY_MAP_GERMANY_ONLY))

    r = merge(_country_revenue_base(m)).groupBy("country").agg(
        F.sum("total_revenue").alias("total_revenue"),
        F.sum("purchasing_users").alias("purchasing_users"))
    f = merge(country_cart_purchase_funnel(m)).groupBy("country").agg(
        F.sum("cart_users").alias("_cart"), F.sum("purchasing_users").alias("_buy"))
    f = f.select("country", round_ratio(F.col("_buy") * 100, F.col("_cart"), 2).alias(
        "cart_to_purchase_conversion_pct"))
    c = merge(country_cancellation_metrics(m)).groupBy("country").agg(
        F.sum("cancelled_items").alias("_c"), F.sum("total_order_items").alias("_t"))
    c = c.select("country", safe_divide(F.col("_c"), F.col("_t")).alias("cancellation_rate"))
    perf = r.join(f, "country", "left").join(c, "country", "left")
    return _final_country(perf, _user_base(m, COUNTRY_MAP_GERMANY_ONLY))


def _of_order_users(m: Model, *grain: str) -> DataFrame:
    """fact_orders JOIN fact_order_items on order_id, summed per order's user (and ``grain``).
    Items are summed per order first, so the join carries a row per order, not per item."""
    items = m.fact_order_items.groupBy("order_id", *grain).agg(
        F.sum("revenue").alias("revenue"), F.count("revenue").alias("n_revenue"))
    orders = m.fact_orders.withColumnRenamed("user_id", "fo_user_id")
    sold = orders.join(items, "order_id", "inner")
    if grain:  # about as many groups as rows: dealt first, so that no task holds a large share of the groups
        sold = deal(sold, m.item_tasks, "fo_user_id", *grain)
    return sold.groupBy("fo_user_id", *grain).agg(
        F.sum("revenue").alias("revenue"), F.sum("n_revenue").alias("n_revenue"))


@shared
def _user_revenue(m: Model) -> DataFrame:
    """A row per user of fact_orders; read by A49-A52."""
    return _of_order_users(m)


@shared
def _user_product_revenue(m: Model) -> DataFrame:
    """A row per user of fact_orders and product; read by A53 and A54."""
    return _of_order_users(m, "product_id")


def _revenue_variance(m: Model, keys: list[str]) -> DataFrame:
    j = _user_revenue(m).join(
        m.dim_user.withColumnRenamed("user_id", "fo_user_id"), "fo_user_id", "inner")
    g = j.groupBy(*keys).agg(
        F.countDistinct("fo_user_id").alias("users"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("n_revenue").alias("_n"))
    return g.select(*keys, "users", "total_revenue",
                    safe_divide(F.col("total_revenue"), F.col("_n")).alias("avg_order_value")
                    ).orderBy(F.col("total_revenue").desc())


def revenue_variance_by_country(m: Model) -> DataFrame:
    """A49 (avg_order_value is the mean item revenue, as in the statement)."""
    return _revenue_variance(m, ["country"])


def revenue_variance_by_demographic(m: Model) -> DataFrame:
    """A50."""
    return _revenue_variance(m, ["gender", "age_group"])
