"""Incremental daily funnel (A42) with Structured Streaming.

Events arrive as files of the canonical ``events`` schema.  Two stateful steps, both bounded
by the watermark:

1. ``dropDuplicatesWithinWatermark`` on (day, stage, id), where id is the session for view
   and cart events and the user for purchases.  This is the distinct set the batch job
   counts.  State keeps a key only until the watermark passes it.
2. A one-day event-time window counting the surviving rows per stage, in append mode: a day
   is emitted once, when the watermark passes its end, and is then final.

The counts equal the batch ``agg_daily_funnel`` for every emitted day, provided no event
arrives later than the watermark delay (the test checks this on the generated events).
Events without a timestamp have no day to land in and are not counted here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillroll.functions.metrics import safe_divide
from tillroll.plans.model import CART, PRODUCT_VIEW, PURCHASE
from tillroll.sources.canonical import EVENTS_SCHEMA


_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 2_419_200}


def _at_least_a_day(delay: str) -> str:
    """Repeats are dropped within the delay but counted per day, so a shorter one would count
    an id twice."""
    parts = re.findall(r"(\d+)\s*([a-z]+?)s?\b", delay.lower())
    if sum(int(n) * _SECONDS.get(unit, 0) for n, unit in parts) < _SECONDS["day"]:
        raise ValueError(f"the watermark must be a day or more, not {delay!r}")
    return delay


def daily_funnel_stream(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """The streaming plan: canonical events in, one row per finished day out."""
    _at_least_a_day(watermark)
    ev = events.filter(F.col("event_type").isin(PRODUCT_VIEW, CART, PURCHASE)
                       & F.col("created_at").isNotNull())
    stage_id = F.when(F.col("event_type") == PURCHASE, F.col("user_id").cast("string")) \
                .otherwise(F.col("session_id"))
    # Watermarks need an instant: the wall-clock time is read in the session zone, which
    # the jobs set to UTC, so day windows and event dates share their boundaries.
    keyed = ev.select(F.col("created_at").cast("timestamp").alias("event_time"),
                      F.to_date("created_at").alias("event_date"),
                      "event_type", stage_id.alias("id"))
    distinct = (keyed.withWatermark("event_time", watermark)
                .dropDuplicatesWithinWatermark(["event_date", "event_type", "id"]))

    def stage(name: str) -> F.Column:
        return F.sum(F.when((F.col("event_type") == name) & F.col("id").isNotNull(), 1)
                     .otherwise(0)).cast("bigint")

    daily = distinct.groupBy(F.window("event_time", "1 day")).agg(
        stage(PRODUCT_VIEW).alias("product_view_sessions"),
        stage(CART).alias("add_to_cart_sessions"),
        stage(PURCHASE).alias("purchasing_users"))
    return daily.select(
        F.to_date(F.col("window.start")).alias("event_date"),
        "product_view_sessions", "add_to_cart_sessions", "purchasing_users",
        safe_divide(F.col("add_to_cart_sessions"), F.col("product_view_sessions")).alias(
            "view_to_cart_rate"),
        safe_divide(F.col("purchasing_users"), F.col("add_to_cart_sessions")).alias(
            "cart_to_purchase_rate"),
        safe_divide(F.col("purchasing_users"), F.col("product_view_sessions")).alias(
            "view_to_purchase_rate"))


def start_daily_funnel(spark: SparkSession, events_path: str, out_path: str,
                       checkpoint_path: str, watermark: str = "2 days",
                       available_now: bool = False,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run the stream from a folder of canonical event files into a parquet folder.

    ``checkpoint_path`` must be on the shared store (e.g. below spark.checkpoint.dir): it
    holds the offsets and the deduplication and window state, so a restarted query resumes
    where it stopped.
    """
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = daily_funnel_stream(reader.parquet(events_path), watermark)
    writer = (out.writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
