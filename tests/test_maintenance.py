"""Monthly tables kept by signed changes equal a rebuild after every batch."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.operators import growth
from tillroll.plans import maintenance
from tillroll.plans.maintenance import MonthlyState, changes, signed
from tillroll.plans.model import Model
from tillroll.plans.versions import Conflict, VersionLog
from tillroll.sources.canonical import (
    EVENTS_SCHEMA,
    ORDER_ITEMS_SCHEMA,
    PRODUCTS_SCHEMA,
    USERS_SCHEMA,
    Sources,
)

STATUSES = ["Processing", "Shipped", "Complete", "Cancelled", "Returned", None]


def frame(spark, rows):
    return spark.createDataFrame(rows, ORDER_ITEMS_SCHEMA).coalesce(2)


def model(spark, rows):
    return Model(Sources(frame(spark, rows), spark.createDataFrame([], PRODUCTS_SCHEMA),
                         spark.createDataFrame([], USERS_SCHEMA), spark.createDataFrame([], EVENTS_SCHEMA)))


def random_item(rng):
    day = dt.datetime(2021, 1, 1) + dt.timedelta(minutes=rng.randrange(400 * 24 * 60))
    return (rng.randrange(60), rng.choice([None, *range(12)]), rng.choice([None, 1, 2]), rng.choice(STATUSES),
            None if rng.random() < 0.05 else day, None if rng.random() < 0.1 else Decimal(rng.randrange(5000)) / 100)


def assert_equal_to_rebuild(state, m):
    pairs = [(state.kpis(), growth.agg_monthly_kpis(m)), (state.revenue_global(), growth.monthly_revenue_global(m)),
             (state.purchasing_users(), growth.monthly_purchasing_users(m)),
             (state.cancellation_rate(), growth.monthly_cancellation_rate(m)),
             (state.cancelled_revenue(), growth.monthly_cancelled_revenue(m)),
             (state.revenue_per_order(), growth.monthly_revenue_per_order(m)),
             (state.revenue_per_user(), growth.monthly_revenue_per_user(m))]
    for got, want in pairs:
        assert spark_rows(got) == spark_rows(want)


@pytest.mark.parametrize("seed,buckets,span", [(1, 1, "month"), (2, 3, "year")])
def test_random_changes_equal_a_rebuild(spark, tmp_path, seed, buckets, span):
    """Inserts, status changes, price changes, moves to another month, deletes, repeated rows."""
    rng = random.Random(seed)
    items = [random_item(rng) for _ in range(250)]
    items += items[:20]
    state = MonthlyState(spark, str(tmp_path / "state"), buckets, span)
    state.build(frame(spark, items))
    assert_equal_to_rebuild(state, model(spark, items))
    for batch in range(2):
        chosen = rng.sample(range(len(items)), 40)
        gone, old, new = set(chosen[:12]), [], []
        for i in chosen:
            old.append(items[i])
            if i not in gone:
                row = list(items[i])
                for at in rng.sample([1, 3, 4, 5], rng.randrange(1, 3)):
                    row[at] = random_item(rng)[at]
                items[i] = tuple(row)
                new.append(items[i])
        items = [r for i, r in enumerate(items) if i not in gone]
        more = [random_item(rng) for _ in range(10)]
        items += more
        assert state.apply(changes(frame(spark, old), frame(spark, new + more)), f"batch {batch}")
        if batch == 0:
            state.compact()
        assert_equal_to_rebuild(state, model(spark, items))
    assert state.applied == ["build", "batch 0", "batch 1"]
    # everything goes
    state.apply(signed(frame(spark, items), -1), "end")
    assert state.totals().count() == 0 and state.counters("orders").count() == 0


def small_state(spark, tmp_path, span="year", **kw):
    d = dt.datetime
    items = [(1, 1, 1, "Complete", d(2021, 1, 5), Decimal("5.00")), (1, 1, 2, "Shipped", d(2021, 1, 5), Decimal("7.00")),
             (2, 1, 1, "Complete", d(2021, 2, 5), Decimal("1.00")), (3, 2, 1, "Complete", d(2021, 3, 5), Decimal("2.00"))]
    state = MonthlyState(spark, str(tmp_path / "state"), span=span, **kw)
    state.build(frame(spark, items))
    return state, items


def test_a_batch_counts_once(spark, tmp_path):
    state, items = small_state(spark, tmp_path)
    more = signed(frame(spark, [(9, 9, 1, "Complete", dt.datetime(2021, 1, 9), Decimal("4.00"))]), 1)
    assert state.apply(more, "monday") and not state.apply(more, "monday")
    assert state.kpis().filter("month = '2021-01-01'").first()["total_orders"] == 2
    with pytest.raises(ValueError):
        state.build(frame(spark, items))


def test_taking_what_is_not_there_changes_nothing(spark, tmp_path):
    state, items = small_state(spark, tmp_path)
    before = spark_rows(state.kpis())
    for wrong in (items[:1] * 3, [(77, 1, 1, "Complete", dt.datetime(2021, 1, 5), None)],
                  [(1, None, 1, None, dt.datetime(2025, 1, 5), None)]):
        with pytest.raises(Exception, match="more rows go than there are"):
            state.apply(signed(frame(spark, wrong), -1), "wrong")
    assert spark_rows(state.kpis()) == before and state.applied == ["build"]


def test_only_touched_counters_are_read(spark, tmp_path):
    """The scan of the old counters opens the files of the touched slots and no others."""
    state, items = small_state(spark, tmp_path, span="month")
    log = VersionLog(spark, state.path)
    entry = log.latest().entry
    late = [(2, 1, 5, "Cancelled", dt.datetime(2021, 2, 7), Decimal("3.00"))]
    state.apply(signed(frame(spark, late), 1), "late")
    part = log.latest().entry["parts"][-1]
    assert state._touched(part, "orders") == ["2021-02-0"]
    seen = {r[0].split("slot=")[1].split("/")[0] for r in state._before(entry, part, "orders").select(
        F.input_file_name()).collect()}
    assert seen == {"2021-02-0"}
    assert state.counters("orders").filter("order_id = 2").first()["n_all"] == 2


def test_a_failed_batch_leaves_the_state(spark, tmp_path, monkeypatch):
    """A job that dies before its commit: nothing changes, and the same batch can run again."""
    state, items = small_state(spark, tmp_path)
    before = spark_rows(state.kpis())
    rows = changes(frame(spark, items[:1]), frame(spark, [(*items[0][:3], "Cancelled", *items[0][4:])]))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(MonthlyState, "_commit", dies)
        with pytest.raises(RuntimeError):
            state.apply(rows, "tuesday")
    assert spark_rows(state.kpis()) == before
    assert state.apply(rows, "tuesday")
    month = state.kpis().filter("month = '2021-01-01'").first()
    assert (month["total_orders"], month["cancelled_orders"], month["total_revenue"]) == (1, 1, Decimal("7.00"))


def test_two_writers(spark, tmp_path, monkeypatch):
    state, items = small_state(spark, tmp_path)
    other = MonthlyState(spark, state.path)
    check = MonthlyState._check

    def slow(self, entry, part):  # another writer is done first
        monkeypatch.setattr(MonthlyState, "_check", check)
        other.apply(signed(frame(spark, items[:1]), 1), "other")
        check(self, entry, part)

    monkeypatch.setattr(MonthlyState, "_check", slow)
    with pytest.raises(Conflict):
        state.apply(signed(frame(spark, items[3:]), -1), "own")
    assert state.applied == ["build", "other"]


def test_parts_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(maintenance, "MAX_PARTS", 2)
    state, items = small_state(spark, tmp_path)
    for i in range(3):
        state.apply(signed(frame(spark, items[:1]), 1 if i % 2 == 0 else -1), f"b{i}")
    assert len(VersionLog(spark, state.path).latest().entry["parts"]) <= 2
    assert_equal_to_rebuild(state, model(spark, items + items[:1]))


def test_the_model_can_be_served_from_it(spark, tmp_path):
    rng = random.Random(5)
    items = [random_item(rng) for _ in range(200)]
    state = MonthlyState(spark, str(tmp_path / "state"), span="year")
    state.build(frame(spark, items))
    m, served = model(spark, items), model(spark, items).use("agg_monthly_kpis", state.kpis())
    for table in (growth.agg_monthly_kpis_enriched, growth.agg_yearly_kpis_enriched):
        assert spark_rows(table(served)) == spark_rows(table(m))
