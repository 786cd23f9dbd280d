"""Findings of the round-1 review, each as a test."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.operators import geography, product
from tillroll.plans.model import Model
from tillroll.plans.warehouse import default_root, read_monthly_kpis, write_monthly_kpis
from tillroll.sources.canonical import EVENTS_SCHEMA, ORDER_ITEMS_SCHEMA, conform, from_frames
from tillroll.streaming.daily_funnel import daily_funnel_stream

ITEM = "order_id long, user_id long, product_id long, status string, created_at timestamp_ntz, sale_price decimal(12,2)"


def _model(spark, items, users=((1, "Spain"),), events=()):
    d = "decimal(12,2)"
    return Model(from_frames(
        spark.createDataFrame(items, ITEM),
        spark.createDataFrame([(1, "cat", "brand", "name", None)], f"id long, category string, brand string, name string, retail_price {d}"),
        spark.createDataFrame([(i, c, "F", 30) for i, c in users], "id long, country string, gender string, age int"),
        spark.createDataFrame(list(events), "id long, user_id long, session_id string, event_type string, created_at timestamp_ntz")))


def _item(order, when, user=1, price=1):
    from decimal import Decimal
    return (order, user, 1, "Complete", when, Decimal(price))


def test_time_of_day_is_kept(spark):
    day = dt.datetime(2021, 1, 1)
    m = _model(spark, [_item(1, day.replace(hour=9, minute=30)), _item(2, day.replace(hour=17, minute=45))])
    row = product.brand_performance_summary(m).first()
    assert (row["first_sale_date"], row["last_sale_date"]) == (dt.datetime(2021, 1, 1, 9, 30), dt.datetime(2021, 1, 1, 17, 45))


def test_lossy_values_fail_at_load(spark):
    rows = spark.createDataFrame([(1, 1, 1, "Complete", dt.datetime(2021, 1, 1), 2.004)],
                                 ITEM.replace("decimal(12,2)", "double"))
    with pytest.raises(Exception, match="sale_price"):
        conform(rows, ORDER_ITEMS_SCHEMA).collect()
    assert str(conform(rows.withColumn("sale_price", F.lit(2.5)), ORDER_ITEMS_SCHEMA).first()["sale_price"]) == "2.50"


def test_instants_become_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        events = spark.sql("select 1L id, 1L user_id, 's' session_id, 'product' event_type, "
                           "timestamp'2021-01-01 03:00:00.25 UTC' created_at")
        assert conform(events, EVENTS_SCHEMA).first()["created_at"] == dt.datetime(2021, 1, 1, 3, 0, 0, 250_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_users_listed_twice_count_once(spark):
    when = dt.datetime(2021, 1, 1)
    m = _model(spark, [_item(1, when)], users=((1, "Spain"), (1, "Spain")), events=[(1, 1, "s", "cart", when)])
    assert geography.country_cart_metrics(m).first()["cart_users"] == 1
    assert geography.country_purchase_users(m).first()["purchasing_users"] == 1
    assert geography.revenue_per_user(m).first()["purchasing_users"] == 1


def test_full_rebuild_leaves_no_stale_months(spark, tmp_path):
    path = str(tmp_path / "f6")
    write_monthly_kpis(_model(spark, [_item(i, dt.datetime(2021, i, 1)) for i in (1, 2, 3)]), path)
    write_monthly_kpis(_model(spark, [_item(1, dt.datetime(2021, 2, 1))]), path)
    assert [r["month"] for r in read_monthly_kpis(spark, path).collect()] == [dt.date(2021, 2, 1)]


def test_items_without_a_date_can_be_refreshed(spark, tmp_path):
    path = str(tmp_path / "f6")
    write_monthly_kpis(_model(spark, [_item(1, dt.datetime(2021, 2, 1)), _item(2, None)]), path)
    assert read_monthly_kpis(spark, path).count() == 2
    write_monthly_kpis(_model(spark, [_item(1, dt.datetime(2021, 2, 1))]), path, [None])
    assert [r["month"] for r in read_monthly_kpis(spark, path).collect()] == [dt.date(2021, 2, 1)]


@pytest.mark.parametrize("delay", ["1 hour", "23 hours 59 minutes", "0 days"])
def test_short_watermarks_are_refused(spark, delay):
    with pytest.raises(ValueError, match="a day or more"):
        daily_funnel_stream(_model(spark, []).events, delay)


def test_no_folder_without_a_shared_one(spark, monkeypatch):
    monkeypatch.setattr("tillroll.plans.warehouse.checkpoint_dir", lambda _: None)
    with pytest.raises(ValueError, match="checkpoint.dir"):
        default_root(spark)


def test_no_input_row_is_left_out(spark):
    sf = "/root/testdata/sf0.001"
    m = Model.from_testdata(spark, sf)
    assert m.products.count() == spark.read.parquet(f"{sf}/part.parquet").count()
    assert m.events.where("user_id is null").count() == spark.read.parquet(f"{sf}/events.parquet").where("user_id is null").count()
