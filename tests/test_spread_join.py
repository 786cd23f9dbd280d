"""Left joins on keys that are often NULL or held by few values."""

import datetime as dt
import random
from decimal import Decimal
from statistics import median

import pytest
from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.functions import joins
from tillroll.functions.joins import find_hot_keys, spread_left_join
from tillroll.operators import category, geography, product, seasonality
from tillroll.plans.model import Model
from tillroll.sources.canonical import EVENTS_SCHEMA, ORDER_ITEMS_SCHEMA, PRODUCTS_SCHEMA, USERS_SCHEMA, Sources

N = 12_000


@pytest.fixture(scope="module")
def skewed(spark):
    """40 % of the items without a user, 20 % of one user; 30 % of one product, 10 % without one."""
    rng = random.Random(1)
    items = []
    for i in range(N):
        user = rng.choices([None, 1, 2 + i % 300], [4, 2, 4])[0]
        item = rng.choices([None, 7, 8 + i % 200], [1, 3, 6])[0]
        items.append((i // 3, user, item, rng.choice(["Complete", "Cancelled", "Returned", None]),
                      dt.datetime(2021, 1, 1) + dt.timedelta(hours=i % 9000), Decimal(rng.randrange(1000)) / 100))
    users = [(u, rng.choice(["Spain", "Germany", "Deutschland", "China", None]), "F", 30) for u in range(1, 280)] + [(1, "France", "M", 31)]
    products = [(p, f"cat{p % 5}", f"b{p}", f"n{p}", Decimal("5.00")) for p in range(7, 190)]
    return Model(Sources(spark.createDataFrame(items, ORDER_ITEMS_SCHEMA).repartition(8), spark.createDataFrame(products, PRODUCTS_SCHEMA),
                         spark.createDataFrame(users, USERS_SCHEMA), spark.createDataFrame([], EVENTS_SCHEMA)))


@pytest.fixture
def plain_execution(spark):
    """No adaptive re-planning and no broadcast: what the plan itself does."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_per_task(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("key", ["user_id", "product_id"])
def test_no_task_of_the_join_reads_twice_the_median(skewed, plain_execution, key):
    items = skewed.order_items
    other = (skewed.users.withColumnRenamed("id", "user_id") if key == "user_id"
             else skewed.products.withColumnRenamed("id", "product_id"))
    others = [c for c in ("order_id", "user_id", "product_id", "created_at", "sale_price") if c != key]
    spread = spread_left_join(items, other, key, skewed.hot_keys(key), others)
    tasks = rows_per_task(spread)
    assert len(tasks) == 16 and tasks[-1] <= 2 * median(tasks)
    naive = rows_per_task(items.join(other, key, "left"))
    assert naive[-1] > 2 * median(naive), "the case is skewed"
    assert spark_rows(spread) == spark_rows(items.join(other, key, "left"))


def test_the_tables_join_that_way(skewed, plain_execution):
    """The four tables' plans shuffle both sides of their left join by key and salt."""
    for table in (category.category_base, geography.agg_country_kpis, product.aggregate_category_kpis, seasonality.country_month_kpis):
        plan = table(Model(skewed.sources))._jdf.queryExecution().executedPlan().toString()
        joined = [line for line in plan.splitlines() if "LeftOuter" in line]
        assert joined and all("_salt" in line for line in joined), table.__name__


def test_hot_keys_are_counted(spark, skewed):
    assert 1 in skewed.hot_keys("user_id") and 7 in skewed.hot_keys("product_id")
    assert skewed.hot_keys("user_id") is skewed.hot_keys("user_id"), "counted once per model"
    even = spark.range(10_000).withColumn("k", F.col("id"))
    assert find_hot_keys(even, "k") == {}
    assert len(find_hot_keys(spark.range(4000).withColumn("k", F.col("id") % 7), "k")) == 7 <= joins.HOT_SHARE
    assert find_hot_keys(even.limit(0), "k") == {}


def test_keys_without_a_match_and_repeated_ones(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (6, 4), (7, 5)], "k long, x int")
    other = spark.createDataFrame([(5, "a"), (5, "b"), (None, "never"), (6, "c")], "k long, y string")
    for hot in ({}, {5: 0.5}, {5: 0.001, 6: 0.3, 7: 0.2}):
        got = spread_left_join(rows, other, "k", hot, ["x"])
        assert spark_rows(got) == spark_rows(rows.join(other, "k", "left"))
