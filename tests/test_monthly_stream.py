"""The monthly funnel stream of two inputs equals F5 for every closed month."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.operators.funnel import agg_funnel_metrics
from tillroll.plans.model import Model
from tillroll.sources.canonical import EVENTS_SCHEMA, ORDER_ITEMS_SCHEMA, PRODUCTS_SCHEMA, USERS_SCHEMA, Sources
from tillroll.streaming.monthly_funnel import clock_month, month_clock, monthly_funnel_stream, start_monthly_funnel


def rows_between(rng, start, days, n, gaps=()):
    items, events = [], []
    for i in range(n):
        t = start + dt.timedelta(minutes=rng.randrange(days * 1440))
        if rng.random() < 0.02:
            t = None
        month = t and (t.year, t.month)
        user = rng.choice([None, *range(25)])
        if month not in gaps:
            items.append((i, user, 1, rng.choice(["Complete", "Shipped", "Cancelled", None]), t, None))
        events.append((i, user, rng.choice([None, f"s{user}", f"s{user}-{i % 7}"]), rng.choice(["product", "cart", "home"]), t))
    return items, [e for e in events if e[4] is None or not (e[3] == "cart" and (e[4].year, e[4].month) == (2021, 4))]


def model(spark, items, events):
    return Model(Sources(spark.createDataFrame(items, ORDER_ITEMS_SCHEMA), spark.createDataFrame([], PRODUCTS_SCHEMA),
                         spark.createDataFrame([], USERS_SCHEMA), spark.createDataFrame(events, EVENTS_SCHEMA)))


def test_the_clock_has_a_day_per_month(spark):
    rng = random.Random(2)
    times = sorted([dt.datetime(2019, 12, 31, 23, 59, 59, 999_999), dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 29, 23, 59, 59, 999_999),
                    dt.datetime(2020, 3, 1), *[dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(10**8)) for _ in range(300)]])
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").withColumn("c", month_clock(F.col("t")))
    got = df.withColumn("w", F.window("c", "1 day")).select("t", "c", clock_month(F.col("w")).alias("m")).orderBy("t").collect()
    assert all(r["m"] == r["t"].date().replace(day=1) for r in got)
    clocks = [r["c"] for r in got]
    assert clocks == sorted(clocks)


def test_closed_months_equal_the_batch_also_after_a_restart(spark, tmp_path):
    """A month without carts, months without buyers, ids in several months, NULL ids and times."""
    rng = random.Random(3)
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    paths = {"items": str(tmp_path / "items"), "events": str(tmp_path / "events")}
    total = ([], [])
    seen = []
    for start, days in ((dt.datetime(2021, 1, 1), 150), (dt.datetime(2021, 5, 20), 140), (dt.datetime(2021, 10, 1), 120)):
        items, events = rows_between(rng, start, days, 400, gaps={(2021, 2), (2021, 8)})
        total[0].extend(items)
        total[1].extend(events)
        m = model(spark, items, events)
        m.order_items.coalesce(2).write.mode("append").parquet(paths["items"])
        m.events.coalesce(2).write.mode("append").parquet(paths["events"])
        # each round is a query of its own, restarted on the same checkpoint
        start_monthly_funnel(spark, paths["events"], paths["items"], out, chk, available_now=True).awaitTermination(600)
        seen.append(spark.read.parquet(out).count())
    assert 0 < seen[0] < seen[1] < seen[2]
    streamed = spark.read.parquet(out)
    batch = agg_funnel_metrics(model(spark, *total)).filter("month is not null")
    closed = [r["month"] for r in streamed.collect()]
    assert len(closed) == len(set(closed)) and max(closed) >= dt.date(2021, 11, 1)
    assert min(closed) == dt.date(2021, 1, 1) and len(closed) >= 10
    assert spark_rows(streamed) == spark_rows(batch.filter(F.col("month").isin(closed)))
    gaps = {r["month"]: r for r in streamed.collect()}
    assert gaps[dt.date(2021, 2, 1)]["purchasing_users"] is None and gaps[dt.date(2021, 4, 1)]["add_to_cart_sessions"] is None


def test_the_slower_input_holds_a_month_open(spark, tmp_path):
    """Order items stop in March: nothing after February is closed, however far events go."""
    rng = random.Random(4)
    items, events = rows_between(rng, dt.datetime(2021, 1, 1), 300, 300)
    items = [i for i in items if i[4] is None or i[4] < dt.datetime(2021, 3, 15)]
    m = model(spark, items, events)
    paths = [str(tmp_path / x) for x in ("events", "items", "out", "chk")]
    m.order_items.coalesce(2).write.parquet(paths[1])
    m.events.coalesce(2).write.parquet(paths[0])
    start_monthly_funnel(spark, *paths, available_now=True).awaitTermination(600)
    got = {r["month"] for r in spark.read.parquet(paths[2]).collect()}
    assert got == {dt.date(2021, 1, 1)}


def test_a_short_delay_is_refused(spark):
    m = model(spark, [], [])
    with pytest.raises(ValueError):
        monthly_funnel_stream(m.events, m.order_items, event_delay=0.5)
