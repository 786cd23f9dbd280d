"""The monthly tables (F6, A31-A36) kept up to date from changes of order items.

A change is a row of order items with a ``sign``: +1 comes, -1 goes. A new status is the old row
with -1 and the new one with +1. Three signed tables add up to the state:

* ``totals``: per month, sums and counts of items, and the numbers of distinct orders and buyers;
* ``orders`` and ``buyers``: per (month, order) and (month, buyer) how many items of each class
  there are, so that a distinct count also goes down, when the last one leaves.

A batch of changes is reduced to its (month, order) and (month, buyer) keys. Only the parts of the
counter tables that hold those keys are read, to see which keys came or went; the batch's own
counters are then written as a further signed part and one commit makes all of it count
(``versions.VersionLog``). Items that did not change are never read again. ``compact`` merges the
parts from time to time.

Every table is a plain Parquet folder, dealt by month and by a hash of the key; a hot order or
buyer is one row per batch after partial aggregation.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.metrics import (
    CANCELLED,
    StatusPolicy,
    month_start,
    round_ratio,
    safe_divide,
    status_in_policy,
)
from tillroll.plans.versions import VersionLog, folders_of

MONEY, EXACT = "decimal(22,2)", "decimal(38,2)"
#: Parts of a state after which ``apply`` merges them; touched slots up to which a read names them.
MAX_PARTS, MAX_NAMED = 8, 5000


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _classes() -> dict[str, Column]:
    """The classes of items whose orders or buyers are counted."""
    status = F.col("status")
    return {"all": F.lit(True), "valid": _is(status_in_policy(status, StatusPolicy.VALID)),
            "cancelled": _is(status == CANCELLED), "kept": _is(status_in_policy(status, StatusPolicy.NOT_CANCELLED))}


#: key column and the classes whose distinct keys are counted, by counter table.
COUNTERS = {"orders": ("order_id", ("all", "valid", "cancelled", "kept")), "buyers": ("user_id", ("valid", "kept"))}


def _sums() -> dict[str, Column]:
    """What is summed per month. A sum over no known price is NULL in the statements, so known
    prices are counted too; cancelled revenue takes 0 from every other item."""
    c, price = _classes(), F.col("sale_price")
    known = price.isNotNull()

    def count(cond: Column) -> Column:
        return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("bigint")

    def money(cond: Column) -> Column:
        return F.when(cond & known, price).otherwise(F.lit(0)).cast(MONEY)

    return {"items": count(c["all"]), "valid_items": count(c["valid"]), "cancelled_items": count(c["cancelled"]),
            "kept_items": count(c["kept"]), "valid_known": count(c["valid"] & known), "kept_known": count(c["kept"] & known),
            "cancelled_terms": count(~c["cancelled"] | known), "valid_revenue": money(c["valid"]),
            "cancelled_revenue": money(c["cancelled"]), "kept_revenue": money(c["kept"])}


_MONEY_SUMS = ("valid_revenue", "cancelled_revenue", "kept_revenue")
_COUNT_SUMS = ("items", "valid_items", "cancelled_items", "kept_items", "valid_known", "kept_known", "cancelled_terms")
_DISTINCTS = [f"{table}_{c}" for table, (_, classes) in COUNTERS.items() for c in classes]


def _counter_schema(table: str) -> T.StructType:
    key, classes = COUNTERS[table]
    return T.StructType([T.StructField("month", T.DateType()), T.StructField(key, T.LongType()),
                         *[T.StructField(f"n_{c}", T.LongType()) for c in classes],
                         T.StructField("batch", T.StringType()), T.StructField("slot", T.StringType())])


_TOTALS_SCHEMA = T.StructType([
    T.StructField("month", T.DateType()), *[T.StructField(n, T.LongType()) for n in (*_COUNT_SUMS, *_DISTINCTS)],
    *[T.StructField(n, T.DecimalType(38, 2)) for n in _MONEY_SUMS], T.StructField("batch", T.StringType())])


def signed(items: DataFrame, sign: int) -> DataFrame:
    return items.select("order_id", "user_id", "product_id", "status", "created_at", "sale_price",
                        F.lit(sign).cast("int").alias("sign"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that turn the rows ``before`` into the rows ``after``; what is in both cancels out."""
    return signed(before, -1).unionByName(signed(after, 1))


class MonthlyState:
    """The maintained state below ``path``. Counters are dealt into slots by time span (``month``, or
    ``year`` where a year's counters are less than a file) and a hash of the key into ``buckets``: about
    the counter bytes of a span over 256 MB. Both are fixed when the state is built."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1, span: str = "month") -> None:
        self.spark, self.path, self.log = spark, path.rstrip("/"), VersionLog(spark, path)
        self._slots = {"buckets": buckets, "span": span}

    # what is stored -------------------------------------------------------------------
    def _entry(self) -> dict:
        latest = self.log.latest()
        return latest.entry if latest else {"parts": [], "applied": [], "slots": self._slots, "folders": []}

    @property
    def applied(self) -> list[str]:
        """Names of the batches that count."""
        return self._entry()["applied"]

    def _folders(self, parts: Iterable[str], table: str) -> list[str]:
        return [f"{self.path}/{table}/batch={p}" for p in parts]

    def _read(self, entry: dict, table: str) -> DataFrame:
        schema = _TOTALS_SCHEMA if table == "totals" else _counter_schema(table)
        if not entry["parts"]:
            return self.spark.createDataFrame([], schema)
        return (self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}")
                .parquet(*self._folders(entry["parts"], table)))

    def counters(self, table: str) -> DataFrame:
        """The counters above 0 of ``orders`` or ``buyers``."""
        key, classes = COUNTERS[table]
        return self._merged(self._read(self._entry(), table), key, classes)

    @staticmethod
    def _merged(rows: DataFrame, key: str, classes: Iterable[str]) -> DataFrame:
        names = [f"n_{c}" for c in classes]
        one = rows.groupBy("slot", "month", key).agg(*[F.sum(n).alias(n) for n in names])
        return one.filter(" OR ".join(f"{n} <> 0" for n in names))

    # changes --------------------------------------------------------------------------
    def build(self, items: DataFrame, batch: str = "build") -> None:
        """The first version, from all items."""
        if self._entry()["applied"]:
            raise ValueError(f"{self.path} is built already")
        self.apply(signed(items, 1), batch)

    def apply(self, rows: DataFrame, batch: str) -> bool:
        """Adds signed rows. ``batch`` names them: a batch that counts already changes nothing, so a
        failed job is simply run again. False then. Fails, with nothing changed, where more rows of a
        class would go from a month, order or buyer than there are, or if another writer committed
        meanwhile."""
        latest, entry = self.log.latest(), self._entry()
        if batch in entry["applied"]:
            return False
        part = uuid.uuid4().hex
        sign = F.col("sign")
        rows = rows.withColumn("month", month_start(F.to_date("created_at")))
        for table, (key, classes) in COUNTERS.items():
            own = _classes()
            names = [f"n_{c}" for c in classes]
            delta = rows.filter(F.col(key).isNotNull()).groupBy("month", key).agg(
                *[F.sum(F.when(own[c], sign).otherwise(F.lit(0))).cast("bigint").alias(f"n_{c}") for c in classes])
            delta = delta.filter(" OR ".join(f"{n} <> 0" for n in names)).withColumn("slot", _slot(key, **entry["slots"]))
            (delta.hint("rebalance", "slot").sortWithinPartitions("slot", key)
             .write.partitionBy("slot").parquet(self._folders([part], table)[0]))
        totals = rows.groupBy("month").agg(*[F.sum(c * sign).cast(EXACT if n in _MONEY_SUMS else "bigint").alias(n)
                                             for n, c in _sums().items()])
        for table in COUNTERS:
            diff = self._came_and_went(entry, part, table).withColumnRenamed("month", "_month")
            totals = totals.join(diff, F.col("month").eqNullSafe(F.col("_month")), "left").drop("_month")
        totals = totals.select("month", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in (*_COUNT_SUMS, *_DISTINCTS, *_MONEY_SUMS)])
        totals.coalesce(1).write.parquet(self._folders([part], "totals")[0])
        self._check(entry, part)
        self._commit({"parts": [*entry["parts"], part], "applied": [*entry["applied"], batch], "slots": entry["slots"]},
                     latest.number if latest else -1)
        if len(entry["parts"]) >= MAX_PARTS:
            self.compact()
        return True

    def _touched(self, part: str, table: str) -> list[str] | None:
        """The slots of a batch's keys; None if they are too many to be named."""
        own = self._read({"parts": [part]}, table).select("slot").distinct().limit(MAX_NAMED + 1).collect()
        return [r["slot"] for r in own] if len(own) <= MAX_NAMED else None

    def _before(self, entry: dict, part: str, table: str) -> DataFrame:
        """The counters before a batch, of the slots it touches only."""
        rows = self._read(entry, table)
        slots = self._touched(part, table)
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))

    def _came_and_went(self, entry: dict, part: str, table: str) -> DataFrame:
        """Per month, by how many each number of distinct keys changes."""
        key, classes = COUNTERS[table]
        own = self._read({"parts": [part]}, table)
        keys = own.select("slot", F.col(key)).distinct()
        old = self._before(entry, part, table).join(keys, ["slot", key], "left_semi")
        both = old.withColumn("_new", F.lit(0)).unionByName(own.withColumn("_new", F.lit(1)))
        one = both.groupBy("month", key).agg(
            *[F.sum(F.when(F.col("_new") == 0, F.col(f"n_{c}")).otherwise(F.lit(0))).alias(f"_old_{c}") for c in classes],
            *[F.sum(f"n_{c}").alias(f"_now_{c}") for c in classes])
        def there(name: str, c: str) -> Column:
            n = F.col(f"{name}_{c}")
            return F.when(n < 0, F.raise_error(F.concat(
                F.lit(f"{table}: more rows go than there are, {key} "), F.col(key).cast("string")))
            ).otherwise((n > 0).cast("int"))

        return one.groupBy("month").agg(*[
            F.sum(there("_now", c) - there("_old", c)).cast("bigint").alias(f"{table}_{c}") for c in classes])

    def _check(self, entry: dict, part: str) -> None:
        """Months never hold fewer than no items (rows without a key aren't in the counters)."""
        merged = _month_totals(self._read({"parts": [*entry["parts"], part]}, "totals"))
        if merged.filter(" OR ".join(f"{n} < 0" for n in _COUNT_SUMS)).limit(1).count():
            raise ValueError("more rows go than there are")

    def _commit(self, entry: dict, after: int) -> None:
        entry["folders"] = [f for table in (*COUNTERS, "totals") for f in self._folders(entry["parts"], table)]
        self.log.commit(entry, after)
        self.log.expire()

    def compact(self) -> None:
        """Merges all parts into one; keys without items go."""
        latest = self.log.latest()
        if latest is None:
            return
        entry, part = latest.entry, uuid.uuid4().hex
        for table, (key, classes) in COUNTERS.items():
            (self._merged(self._read(entry, table), key, classes).hint("rebalance", "slot").sortWithinPartitions("slot", key)
             .write.partitionBy("slot").parquet(self._folders([part], table)[0]))
        _month_totals(self._read(entry, "totals")).filter("items > 0").coalesce(1).write.parquet(self._folders([part], "totals")[0])
        self._commit(entry | {"parts": [part]}, latest.number)

    # the tables ------------------------------------------------------------------------
    def totals(self) -> DataFrame:
        """A row per month that has items."""
        return _month_totals(self._read(self._entry(), "totals")).filter("items > 0")

    def kpis(self) -> DataFrame:
        """F6, as ``operators.growth.agg_monthly_kpis``."""
        t = self.totals().filter("valid_items > 0")
        known = F.col("month").isNotNull()
        revenue = F.when(F.col("valid_known") > 0, F.col("valid_revenue").cast(MONEY))
        cancelled = F.when(F.col("cancelled_terms") > 0, F.col("cancelled_revenue").cast(MONEY))
        orders, buyers = F.col("orders_valid"), F.col("buyers_valid")
        return t.select(
            "month", revenue.alias("total_revenue"), orders.alias("total_orders"), buyers.alias("purchasing_users"),
            safe_divide(revenue, orders).alias("avg_order_value"), safe_divide(revenue, buyers).alias("revenue_per_user"),
            F.when(known, F.col("orders_all")).alias("total_orders_all"),
            F.when(known, F.col("orders_cancelled")).alias("cancelled_orders"),
            F.when(known, safe_divide(F.col("orders_cancelled"), F.col("orders_all"))).alias("cancellation_rate"),
            F.when(known, cancelled).alias("cancelled_revenue"))

    def _kept(self) -> DataFrame:
        return self.totals().filter("kept_items > 0").withColumn(
            "total_revenue", F.when(F.col("kept_known") > 0, F.col("kept_revenue").cast(MONEY)))

    def revenue_global(self) -> DataFrame:
        """A31."""
        return self._kept().select("month", "total_revenue", F.col("orders_kept").alias("total_orders"))

    def purchasing_users(self) -> DataFrame:
        """A32."""
        return self.totals().filter("buyers_kept > 0").select("month", F.col("buyers_kept").alias("purchasing_users"))

    def cancellation_rate(self) -> DataFrame:
        """A33."""
        return self.totals().select("month", (F.col("cancelled_items") / F.col("items")).alias("cancellation_rate"))

    def cancelled_revenue(self) -> DataFrame:
        """A34."""
        return self.totals().select("month", F.when(
            F.col("cancelled_terms") > 0, F.col("cancelled_revenue").cast(MONEY)).alias("cancelled_revenue"))

    def revenue_per_order(self) -> DataFrame:
        """A35."""
        return self.revenue_global().select("*", round_ratio(
            F.col("total_revenue"), F.col("total_orders"), 2, money=True).alias("revenue_per_order"))

    def revenue_per_user(self) -> DataFrame:
        """A36."""
        kept = self._kept().select("month", "total_revenue", F.col("buyers_kept").alias("purchasing_users"))
        return kept.select("*", round_ratio(
            F.col("total_revenue"), F.col("purchasing_users"), 2, money=True).alias("revenue_per_user"))


def _slot(key: str, buckets: int, span: str) -> Column:
    """Where a key's counters lie: its month or year and a bucket of keys."""
    time = F.coalesce(F.date_format("month", {"month": "yyyy-MM", "year": "yyyy"}[span]), F.lit("none"))
    return F.concat(time, F.lit("-"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))


def _month_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("month").agg(*[F.sum(n).cast("bigint").alias(n) for n in (*_COUNT_SUMS, *_DISTINCTS)],
                                     *[F.sum(n).cast(EXACT).alias(n) for n in _MONEY_SUMS])


__all__ = ["COUNTERS", "MonthlyState", "changes", "folders_of", "signed"]
