"""What a task joins or groups stays bounded: numbers of tasks follow the rows, and no step sends more than it holds."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.functions import joins
from tillroll.operators import maintained
from tillroll.plans.distincts import DistinctState
from tillroll.plans.model import Model
from tillroll.registry import run_query

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_rows(monkeypatch):
    """As if the small table had many rows."""
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 300)
    monkeypatch.setattr(joins, "FEW_ROWS", 1000)


def test_tasks_follow_the_rows(spark, many_rows):
    assert joins.tasks_for(spark, 1000) is None
    assert joins.tasks_for(spark, 1001) == spark.sparkContext.defaultParallelism
    assert joins.tasks_for(spark, 60_000) == 200


@pytest.mark.parametrize("key", ["category_user_skew", "revenue_by_category", "aggregate_category_kpis", "revenue_variance_by_country",
                                 "revenue_variance_by_demographic", "user_revenue_by_country", "user_revenue_distribution"])
def test_items_are_dealt_by_their_number(spark, small_model, many_rows, key):
    """Both sides of the join that makes the items ask for a number of tasks, which adaptive execution
    keeps; so do the groups per user and product."""
    m = Model.from_testdata(spark, SF)
    tasks = joins.tasks_for(spark, m.sources.n_items)
    assert tasks == m.item_tasks == -(-m.sources.n_items // 300) >= 20
    got = run_query(key, m)
    plan = plan_of(got)
    assert "hashpartitioning(l_orderkey#" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan
    if key in ("category_user_skew", "revenue_by_category"):
        assert any("fo_user_id" in line and "product_id" in line and f"{tasks}), REPARTITION_BY_NUM" in line for line in plan.splitlines())
    assert spark_rows(got) == spark_rows(run_query(key, small_model))


def test_few_items_are_left_to_spark(spark):
    m = Model.from_testdata(spark, SF)
    assert m.item_tasks is None and "REPARTITION_BY_NUM" not in plan_of(run_query("category_user_skew", m))


@pytest.mark.parametrize("replay", [maintained.replayed_months, maintained.replayed_days])
def test_a_history_joins_its_items_once(spark, tmp_path, monkeypatch, replay):
    """The states read items that were written once, and the folder goes when the state stands."""
    monkeypatch.setattr(maintained, "_new_folder", lambda m, what: str(tmp_path / what))
    m, seen = Model.from_testdata(spark, SF), spark.sparkContext.accumulator(0)
    items = m.order_items
    m.use("order_items", spark.createDataFrame(items.rdd.map(lambda r: (seen.add(1), r)[1]), items.schema))
    replay(m, str(tmp_path / "state"))
    assert seen.value == items.count()
    assert not (tmp_path / "items").exists()


def test_bits_are_set_where_their_numbers_meet(spark):
    """Numbers are shuffled, not a row of bits per task that saw one of them."""
    numbers = spark.range(100_000).select(
        (F.col("id") % 2).cast("string").alias("measure"), F.date_add(F.lit(dt.date(2021, 1, 1)), (F.col("id") % 3).cast("int")).alias("day"),
        F.col("id").alias("number"),
        F.bitmap_bucket_number("id").alias("bucket"))
    bits = DistinctState._bits(numbers.repartition(8))
    steps = ["set" if "bitmap_construct_agg" in line else "Exchange" for line in plan_of(bits).splitlines()
             if "bitmap_construct_agg" in line or "Exchange" in line]
    assert steps[:3] == ["set", "set", "Exchange"], "no exchange between partial and final"
    assert bits.agg(F.sum(F.bitmap_count("bits"))).first()[0] == 100_000
