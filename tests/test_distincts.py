"""Distinct counts from stored bitmaps equal countDistinct over any span."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.operators import funnel, growth
from tillroll.plans.distincts import _IDS, DistinctState, activity
from tillroll.plans.model import Model
from tillroll.plans.versions import VersionLog
from tillroll.sources.canonical import EVENTS_SCHEMA, ORDER_ITEMS_SCHEMA, PRODUCTS_SCHEMA, USERS_SCHEMA, Sources


def rows_of_days(rng, days):
    items, events = [], []
    for day in days:
        for _ in range(rng.randrange(2, 12)):
            t = day and day + dt.timedelta(minutes=rng.randrange(1440))
            user = rng.choice([None, *range(30)])
            items.append((rng.randrange(90), user, 1, rng.choice(["Complete", "Cancelled", "Returned", None]), t, None))
            events.append((len(events), user, rng.choice([None, f"s{user}-{day}", "shared"]),
                           rng.choice(["product", "cart", "purchase", "home"]), t))
    return items, events


def frames(spark, rows):
    return (spark.createDataFrame(rows[0], ORDER_ITEMS_SCHEMA).coalesce(2), spark.createDataFrame(rows[1], EVENTS_SCHEMA).coalesce(2))


def test_appended_days_equal_count_distinct(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2021, 11, 20)
    days = [start + dt.timedelta(days=3 * i) for i in range(30)] + [None]
    state = DistinctState(spark, str(tmp_path / "bits"))
    total = ([], [])
    # days in order, then late rows of old days
    for n, part in enumerate((days[:15], days[15:25], days[25:] + days[3:6])):
        rows = rows_of_days(rng, part)
        total[0].extend(rows[0])
        total[1].extend(rows[1])
        assert state.append(*frames(spark, rows), f"append {n}")
        assert not state.append(*frames(spark, rows), f"append {n}")
        every = activity(*frames(spark, total))
        for grain, period in (("day", F.col("day")), ("month", F.trunc("day", "MM")), ("year", F.trunc("day", "YEAR"))):
            want = every.groupBy("measure", period.alias("period")).agg(F.countDistinct("key").alias("n"))
            assert spark_rows(state.distinct(grain)) == spark_rows(want)
    ids = state._read(state._entry(), "ids", _IDS)
    for kind, n, least, most in [tuple(r) for r in ids.groupBy("kind").agg(
            F.count_distinct("number"), F.min("number"), F.max("number")).collect()]:
        assert least == 1 and most == n == ids.filter(F.col("kind") == kind).count(), "numbers are dense"


def test_statements_read_their_counts_from_it(spark, small_model, tmp_path):
    """F5, F6, A32 and A42 take the same numbers."""
    state = DistinctState(spark, str(tmp_path / "bits"))
    state.append(small_model.order_items, small_model.events, "all")
    month, day = state.table("month"), state.table("day")
    f6 = growth.agg_monthly_kpis(small_model).select("month", "total_orders", "purchasing_users", "total_orders_all", "cancelled_orders")
    assert spark_rows(f6) == spark_rows(month.filter("orders_valid > 0").select(
        F.col("period").alias("month"), F.col("orders_valid").alias("total_orders"), F.col("buyers_valid").alias("purchasing_users"),
        F.col("orders_all").alias("total_orders_all"), F.col("orders_cancelled").alias("cancelled_orders")))
    a32 = growth.monthly_purchasing_users(small_model)
    assert spark_rows(a32) == spark_rows(month.filter("buyers_kept > 0").select(
        F.col("period").alias("month"), F.col("buyers_kept").alias("purchasing_users")))
    f5 = funnel.agg_funnel_metrics(small_model).select("month", "product_view_sessions", "add_to_cart_sessions", "purchasing_users")
    own = month.select(F.col("period").alias("month"), F.col("view_sessions").alias("product_view_sessions"),
                       F.col("cart_sessions").alias("add_to_cart_sessions"), F.col("buyers_valid").alias("purchasing_users"))
    # the statement has NULL where a month has no carts or no buyers at all
    assert spark_rows(f5.fillna(0)) == spark_rows(own.filter("product_view_sessions > 0"))
    a42 = funnel.agg_daily_funnel(small_model).select("event_date", "product_view_sessions", "add_to_cart_sessions", "purchasing_users")
    assert spark_rows(a42) == spark_rows(day.filter("view_sessions + cart_sessions + event_buyers > 0").select(
        F.col("period").alias("event_date"), F.col("view_sessions").alias("product_view_sessions"),
        F.col("cart_sessions").alias("add_to_cart_sessions"), F.col("event_buyers").alias("purchasing_users")))


def test_an_append_reads_no_old_items(spark, small_model, tmp_path):
    """Months and years come from the bitmap files alone."""
    state = DistinctState(spark, str(tmp_path / "bits"))
    state.append(small_model.order_items, small_model.events, "all")
    files = set(state.distinct("year")._jdf.inputFiles())
    assert files and all("/bits/batch=" in f for f in files)


def test_a_failed_append_changes_nothing(spark, small_model, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = frames(spark, rows_of_days(rng, [dt.datetime(2022, 1, 1)]))
    more = frames(spark, rows_of_days(rng, [dt.datetime(2022, 1, 2)]))
    state = DistinctState(spark, str(tmp_path / "bits"))
    state.append(*rows, "one")
    before = spark_rows(state.distinct("day"))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(VersionLog, "commit", dies)
        try:
            state.append(*more, "two")
        except RuntimeError:
            pass
    assert spark_rows(state.distinct("day")) == before
    assert state.append(*more, "two") and state.applied == ["one", "two"]


def test_no_rows(spark, tmp_path):
    m = Model(Sources(spark.createDataFrame([], ORDER_ITEMS_SCHEMA), spark.createDataFrame([], PRODUCTS_SCHEMA),
                      spark.createDataFrame([], USERS_SCHEMA), spark.createDataFrame([], EVENTS_SCHEMA)))
    state = DistinctState(spark, str(tmp_path / "bits"))
    state.append(m.order_items, m.events, "none")
    assert state.table("month").count() == 0
