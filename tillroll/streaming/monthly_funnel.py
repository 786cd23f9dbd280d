"""Incremental monthly funnel (F5) with Structured Streaming, from two inputs.

View and cart sessions come from events, buyers from order items; each input has a watermark of
its own, and the slower one decides when a month is closed. A month is emitted once, when no
more rows of it are expected from either side, and is then final.

Windows have a fixed length and months don't, so both streams run on a clock on which every
calendar month takes one day: ``month_clock`` maps a time to the day of its month's number and the
share of the month that has passed. It grows with the time, so watermarks keep their meaning,
and a one-day window is a calendar month. On that clock:

1. ``dropDuplicatesWithinWatermark`` keeps one row per (month, stage, session) and per (month,
   buyer); its delay is a month or more, so no repeat within a month is counted twice.
2. A window per month counts what is left, in append mode. Shuffles carry distinct ids only, and
   a hot session, buyer or month is collapsed before them.
3. A stateful left outer join on the month puts buyers beside sessions; months without buyers
   come with NULL, as in the statement.

Rows without a time have no month to land in and are not counted here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.functions.metrics import StatusPolicy, safe_divide, status_in_policy
from tillroll.plans.model import CART, PRODUCT_VIEW
from tillroll.sources.canonical import EVENTS_SCHEMA, ORDER_ITEMS_SCHEMA

_DAY = 86_400_000_000  # microseconds


def month_clock(time: Column) -> Column:
    """A time on the clock on which each month is one day, as a timestamp. ``time`` has no zone."""
    start = F.date_trunc("month", time).cast("timestamp")
    end = (F.date_trunc("month", time) + F.expr("interval 1 month")).cast("timestamp")
    passed = F.unix_micros(time.cast("timestamp")) - F.unix_micros(start)
    whole = F.unix_micros(end) - F.unix_micros(start)
    # microseconds of a month times those of a day are beyond 64 bits, so the share is a double; it
    # stays below 1, and the whole day is added exactly
    share = F.least(F.floor(passed / whole * F.lit(float(_DAY))), F.lit(_DAY - 1)).cast("bigint")
    number = (F.year(time) * 12 + F.month(time) - 1).cast("bigint")
    return F.timestamp_micros(number * F.lit(_DAY) + share)


def clock_month(window: Column) -> Column:
    """The first day of the calendar month of a one-day window."""
    number = F.datediff(window["start"], F.lit("1970-01-01").cast("date"))
    return F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1))


def _delay(months: float) -> str:
    """Repeats are dropped within the delay but counted per month, so a shorter one would count an
    id twice."""
    if months < 1:
        raise ValueError(f"the watermark must be a month or more, not {months}")
    return f"{int(months * 86_400)} seconds"


def monthly_funnel_stream(events: DataFrame, items: DataFrame, event_delay: float = 1, item_delay: float = 1) -> DataFrame:
    """The streaming plan: canonical events and order items in, one row per closed month out, in the
    columns of F5. Delays are in months, 1 at least."""
    kind = F.col("event_type")
    seen = (events.filter(kind.isin(PRODUCT_VIEW, CART) & F.col("created_at").isNotNull())
            .select(month_clock(F.col("created_at")).alias("clock"), "event_type", F.col("session_id").alias("id"))
            .withWatermark("clock", _delay(event_delay))
            .withColumn("day", F.to_date("clock"))
            .dropDuplicatesWithinWatermark(["day", "event_type", "id"]))

    def count(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    known = F.col("id").isNotNull()
    stages = seen.groupBy(F.window("clock", "1 day")).agg(
        count((kind == PRODUCT_VIEW) & known).alias("product_view_sessions"),
        count((kind == CART) & known).alias("_carts"),
        count(kind == PRODUCT_VIEW).alias("_has_views"), count(kind == CART).alias("_has_carts"))
    stages = stages.filter("_has_views > 0")
    sold = (items.filter(status_in_policy(F.col("status"), StatusPolicy.VALID) & F.col("created_at").isNotNull())
            .select(month_clock(F.col("created_at")).alias("clock"), "user_id")
            .withWatermark("clock", _delay(item_delay))
            .withColumn("day", F.to_date("clock"))
            .dropDuplicatesWithinWatermark(["day", "user_id"]))
    buyers = sold.groupBy(F.window("clock", "1 day")).agg(
        count(F.col("user_id").isNotNull()).alias("purchasing_users"))
    both = stages.join(buyers, "window", "leftOuter")
    out = both.select(
        clock_month(F.col("window")).alias("month"), "product_view_sessions",
        F.when(F.col("_has_carts") > 0, F.col("_carts")).alias("add_to_cart_sessions"), "purchasing_users")
    return out.select(
        "*", safe_divide(F.col("add_to_cart_sessions"), F.col("product_view_sessions")).alias("view_to_cart_rate"),
        safe_divide(F.col("purchasing_users"), F.col("add_to_cart_sessions")).alias("cart_to_purchase_rate"),
        safe_divide(F.col("purchasing_users"), F.col("product_view_sessions")).alias("view_to_purchase_rate"))


def start_monthly_funnel(spark: SparkSession, events_path: str, items_path: str, out_path: str, checkpoint_path: str,
                         event_delay: float = 1, item_delay: float = 1, available_now: bool = False,
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run the stream from folders of canonical event and order item files into a parquet folder.
    ``checkpoint_path`` must be on the shared store: it holds the offsets and all state, so a
    restarted query goes on where it stopped."""
    def read(schema, path: str) -> DataFrame:
        reader = spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        return reader.parquet(path)

    out = monthly_funnel_stream(read(EVENTS_SCHEMA, events_path), read(ORDER_ITEMS_SCHEMA, items_path), event_delay, item_delay)
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
