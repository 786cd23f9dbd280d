"""Result tables served from maintained state instead of a rebuild.

The registered forms replay a history that ends in the given tables: items that change their
status, arrive late, or are booked twice and taken back; days that come one after the other. So
what they return must equal the tables rebuilt from scratch, and their work grows with the input.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.metrics import PROCESSING
from tillroll.plans.distincts import MEASURES, DistinctState
from tillroll.plans.maintenance import MonthlyState, changes, signed
from tillroll.plans.model import Model
from tillroll.session import scratch_root

#: Where the replayed history of ``distinct_by_period`` is cut into two appends.
FIRST_DAYS_END = dt.datetime(2023, 1, 1)


def _new_folder(m: Model, what: str) -> str:
    return f"{scratch_root(m.order_items.sparkSession)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def _written_once(m: Model, *columns: str) -> Iterator[DataFrame]:
    """These columns of the order items, written to a folder of their own while a state is built: a history reads them
    many times, and each time would join and shuffle them again."""
    items, folder = m.order_items.select(*columns), _new_folder(m, "items")
    spark = items.sparkSession
    items.write.parquet(folder)
    try:
        yield spark.read.schema(items.schema).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replayed_months(m: Model, path: str) -> MonthlyState:
    """The monthly state after a history of three batches. First some orders are still Processing,
    some have not arrived and some are booked twice; then the first get their status; then the second
    arrive and the double bookings go."""
    kind = F.pmod(F.xxhash64("order_id"), F.lit(7))
    open_, late, twice = kind == 0, kind == 1, kind == 2
    with _written_once(m, "order_id", "user_id", "product_id", "status", "created_at", "sale_price") as items:
        begun = items.filter(open_).withColumn("status", F.lit(PROCESSING))
        state = MonthlyState(items.sparkSession, path, span="year")
        state.build(items.filter(~open_ & ~late).unionByName(items.filter(twice)).unionByName(begun), "opening")
        state.apply(changes(begun, items.filter(open_)), "status changes")
        state.apply(signed(items.filter(late), 1).unionByName(signed(items.filter(twice), -1)), "late and double bookings")
    return state


def agg_monthly_kpis_maintained(m: Model) -> DataFrame:
    """F6 from the maintained state."""
    return replayed_months(m, _new_folder(m, "months")).kpis()


def monthly_reports_maintained(m: Model) -> DataFrame:
    """A31 to A36 side by side, from the maintained state: a row per month with items."""
    state = replayed_months(m, _new_folder(m, "months"))
    out = state.cancellation_rate()
    reports = (state.cancelled_revenue(), state.revenue_per_order(), state.purchasing_users(),
               state.revenue_per_user().select("month", "revenue_per_user"))
    for report in reports:
        other = report.withColumnRenamed("month", "_month")
        out = out.join(other, F.col("month").eqNullSafe(F.col("_month")), "left").drop("_month")
    return out


def replayed_days(m: Model, path: str) -> DistinctState:
    """The distinct state after two appends: everything before a day, then the rest."""
    state = DistinctState(m.order_items.sparkSession, path)
    first = F.coalesce(F.col("created_at") < F.lit(FIRST_DAYS_END).cast("timestamp_ntz"), F.lit(False))
    with _written_once(m, "order_id", "user_id", "status", "created_at") as items:
        state.append(items.filter(first), m.events.filter(first), "first days")
        state.append(items.filter(~first), m.events.filter(~first), "later days")
    return state


def distinct_by_period(m: Model) -> DataFrame:
    """Exact distinct orders, buyers and sessions per day, month and year from one table of bitmaps."""
    state = replayed_days(m, _new_folder(m, "distincts"))
    out = None
    for grain in ("day", "month", "year"):
        one = state.table(grain).select(F.lit(grain).alias("grain"), "period", *MEASURES)
        out = one if out is None else out.unionByName(one)
    return out
