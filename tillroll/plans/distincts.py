"""Exact distinct counts over any span of days from one stored table of bitmaps.

Every order, user and session gets a dense number when it is first seen. A day's distinct set of
a measure is then a row of bits per bucket of 32,768 numbers, and sets of days are united by OR-ing
bits: the distinct count of a month or a year comes from the days' rows, not from the items.

``DistinctState.append`` takes the rows of new days only. It numbers the keys it has not seen
(an anti join with the stored numbers), writes the days' bitmaps and commits both at once. New
numbers follow the order of (first day, key), so that the keys of a day, which for
orders and sessions seldom come again, fill few buckets. Rows that leave again are beyond a
bitmap; see ``maintenance`` for those.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.metrics import CANCELLED, StatusPolicy, month_start, status_in_policy
from tillroll.plans.model import CART, PRODUCT_VIEW, PURCHASE
from tillroll.plans.versions import VersionLog

#: measure -> kind of key
MEASURES = {"orders_all": "order", "orders_valid": "order", "orders_cancelled": "order", "orders_kept": "order",
            "buyers_valid": "user", "buyers_kept": "user", "view_sessions": "session", "cart_sessions": "session",
            "event_buyers": "user"}
_IDS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()),
                     T.StructField("number", T.LongType()), T.StructField("batch", T.StringType())])
_BITS = T.StructType([T.StructField("measure", T.StringType()), T.StructField("day", T.DateType()),
                      T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType()),
                      T.StructField("batch", T.StringType())])


def _flagged(rows: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """(measures, day, kind, key): one row per (day, key) with the measures it counts in. A hot key collapses
    in the partial aggregate, and no row is copied per measure."""
    one = rows.filter(F.col(key).isNotNull()).groupBy("day", key).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    held = F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in flags]), lambda x: x.isNotNull())
    kind = MEASURES[next(iter(flags))]
    return one.select(held.alias("measures"), "day", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))


def activity(items: DataFrame, events: DataFrame) -> DataFrame:
    """Which keys each measure has on each day (NULL: rows without a time)."""
    return _active(items, events).select(F.explode("measures").alias("measure"), "day", "kind", "key")


def _active(items: DataFrame, events: DataFrame) -> DataFrame:
    status = F.col("status")
    valid, kept = status_in_policy(status, StatusPolicy.VALID), status_in_policy(status, StatusPolicy.NOT_CANCELLED)
    sold = items.select("order_id", "user_id", "status", F.to_date("created_at").alias("day"))
    seen = events.select("user_id", "session_id", "event_type", F.to_date("created_at").alias("day"))
    kind = F.col("event_type")
    parts = [
        _flagged(sold, "order_id", {"orders_all": F.lit(True), "orders_valid": valid, "orders_cancelled": status == CANCELLED,
                                    "orders_kept": kept}),
        _flagged(sold, "user_id", {"buyers_valid": valid, "buyers_kept": kept}),
        _flagged(seen.filter(kind.isin(PRODUCT_VIEW, CART)), "session_id",
                 {"view_sessions": kind == PRODUCT_VIEW, "cart_sessions": kind == CART}),
        _flagged(seen.filter(kind == PURCHASE), "user_id", {"event_buyers": F.lit(True)})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.size("measures") > 0)


class DistinctState:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.log = spark, path.rstrip("/"), VersionLog(spark, path)

    def _entry(self) -> dict:
        latest = self.log.latest()
        return latest.entry if latest else {"parts": [], "applied": [], "next": {}, "folders": []}

    @property
    def applied(self) -> list[str]:
        return self._entry()["applied"]

    def _read(self, entry: dict, table: str, schema: T.StructType) -> DataFrame:
        if not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
                .parquet(*[f"{self.path}/{table}/batch={p}" for p in entry["parts"]]))

    def append(self, items: DataFrame, events: DataFrame, batch: str) -> bool:
        """Adds the rows of new days (or late rows of old ones). A batch that counts already changes
        nothing (False), so a failed job is simply run again."""
        latest, entry = self.log.latest(), self._entry()
        if batch in entry["applied"]:
            return False
        part = uuid.uuid4().hex
        own = f"{self.path}/work/{part}"
        _active(items, events).write.parquet(f"{own}/activity")
        rows = self.spark.read.parquet(f"{own}/activity")
        after = self._number(rows, entry, part, own)
        ids = self._read(entry | {"parts": [*entry["parts"], part]}, "ids", _IDS).select("kind", "key", "number")
        numbers = rows.join(ids, ["kind", "key"]).select(
            F.explode("measures").alias("measure"), "day", "number", F.bitmap_bucket_number("number").alias("bucket"))
        self._bits(numbers).hint("rebalance", "measure", "day").sortWithinPartitions("measure", "day", "bucket").write.option(
            "compression", "zstd").parquet(f"{self.path}/bits/batch={part}")
        parts = [*entry["parts"], part]
        self.log.commit({"parts": parts, "applied": [*entry["applied"], batch], "next": after,
                         "folders": [f"{self.path}/{t}/batch={p}" for p in parts for t in ("ids", "bits")]},
                        latest.number if latest else -1)
        self.log.expire()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return True

    @staticmethod
    def _bits(numbers: DataFrame) -> DataFrame:
        """A row of bits per (measure, day, bucket). Numbers are dealt before their bits are set: a group has 32,768
        at most, while every task that saw one of them would send a whole row of bits."""
        by = ["measure", "day", "bucket"]
        return numbers.repartition(*by).groupBy(*by).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))

    def _number(self, rows: DataFrame, entry: dict, part: str, own: str) -> dict[str, int]:
        """Numbers the keys that have none yet, from the next free number of their kind on. Returns
        the next free numbers. Each task numbers its own sorted range of keys; what is shared is
        one row per task and kind."""
        known = self._read(entry, "ids", _IDS).select("kind", "key")
        new = rows.groupBy("kind", "key").agg(F.min("day").alias("first")).join(known, ["kind", "key"], "left_anti")
        (new.repartitionByRange("kind", "first", "key").sortWithinPartitions("kind", "first", "key")
         .withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{own}/new"))
        new = self.spark.read.parquet(f"{own}/new").withColumn("task", F.shiftright("at", 33))
        tasks = new.groupBy("kind", "task").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n"))
        start, free = [], dict(entry["next"])
        for r in tasks.orderBy("kind", "task").toLocalIterator():
            start.append((r["kind"], r["task"], free.setdefault(r["kind"], 1) - r["least"]))
            free[r["kind"]] += r["n"]
        offsets = self.spark.createDataFrame(start, "kind string, task long, shift long")
        (new.join(offsets, ["kind", "task"]).select("kind", "key", (F.col("at") + F.col("shift")).alias("number"))
         .write.parquet(f"{self.path}/ids/batch={part}"))
        return free

    def bitmaps(self) -> DataFrame:
        """(measure, day, bucket, bits, batch): the stored table."""
        return self._read(self._entry(), "bits", _BITS)

    def distinct(self, grain: str) -> DataFrame:
        """(measure, period, n): exact distinct keys per ``day``, ``month`` or ``year``; months and years
        by their first day, NULL for rows without a time."""
        day = F.col("day")
        period = {"day": day, "month": month_start(day), "year": F.trunc(day, "YEAR")}[grain]
        united = self.bitmaps().groupBy("measure", period.alias("period"), "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return united.groupBy("measure", "period").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("n"))

    def table(self, grain: str) -> DataFrame:
        """A row per period with a column per measure."""
        return self.distinct(grain).groupBy("period").agg(*[
            F.coalesce(F.max(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(m) for m in MEASURES])
