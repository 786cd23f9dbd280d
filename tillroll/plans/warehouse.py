"""Materialisation: the CTAS boundary of the original layered model.

``materialize`` writes the four canonical inputs once (this is where the expensive
joins of the source mapping run) and returns a Model reading the written tables, so the
dashboard jobs that follow each start from a pruned parquet scan instead of re-running
the mapping.  ``write_table`` and ``write_catalog_table`` are the sinks for result tables:
like CREATE OR REPLACE TABLE, and the old rows stay until the new ones are whole
(``versions``).  ``plans.refresh`` runs a whole refresh.

Output goes to a folder the caller names, by default below the session's shared
checkpoint folder (``spark.checkpoint.dir``), never to a machine-local temporary path.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.metrics import month_start
from tillroll.plans.model import Model
from tillroll.plans.versions import VersionLog, read_table, replace_table, switch_catalog_table
from tillroll.session import checkpoint_dir
from tillroll.sources.canonical import load_layer

#: The column by which stored order items are partitioned.
ITEM_MONTH = "order_month"


def default_root(spark: SparkSession) -> str:
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("no output folder given and spark.checkpoint.dir is not set")
    return f"{base.rstrip('/')}/tillroll-warehouse-{uuid.uuid4().hex[:8]}"


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """CREATE OR REPLACE TABLE ... AS: ``df`` becomes the newest version of the table at ``path``
    (``read_table`` reads it). A job that dies leaves the old rows."""
    replace_table(df, path, partition_by)


def layer_frames(model: Model, slots: int | None = None) -> dict[str, DataFrame]:
    """The four canonical inputs as they are stored.

    Order items are dealt by month, the partition column, and within it by slots of orders; each
    file is sorted by order, so the items of an order land in one file and map-side partial
    aggregates collapse per-order distinct counts before any shuffle. Events are clustered by
    ``user_id`` and sorted by time. Clustering uses the ``rebalance`` hint, not a plain
    repartition: AQE splits the part of a hot order or user into several tasks and files instead
    of leaving one task to write a third of the table, and coalesces small parts. ``slots`` per
    month default to a 64th of the shuffle partitions, which a session sets by the input's size."""
    src = model.sources
    if slots is None:
        slots = max(1, int(src.order_items.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 64)
    items = src.order_items.withColumn(ITEM_MONTH, month_start(F.to_date("created_at")))
    dealt = items.withColumn("_slot", F.pmod(F.xxhash64("order_id"), F.lit(slots))).hint("rebalance", ITEM_MONTH, "_slot")
    return {
        "order_items": dealt.sortWithinPartitions(ITEM_MONTH, "_slot", "order_id").drop("_slot"),
        "products": src.products,
        "users": src.users,
        "events": src.events.hint("rebalance", "user_id").sortWithinPartitions("created_at")}


PARTITIONED = {"order_items": [ITEM_MONTH]}


def materialize(model: Model, root: str | None = None) -> Model:
    """Write the model's four canonical inputs (``layer_frames``) into the folder ``root`` and return
    a Model on them. ``plans.refresh.refresh_layer`` does it with checks and old versions kept."""
    spark = model.order_items.sparkSession
    root = root or default_root(spark)
    for name, df in layer_frames(model).items():
        df.write.mode("overwrite").partitionBy(*PARTITIONED.get(name, [])).parquet(f"{root}/{name}")
    return Model(load_layer(spark, root), status_policy=model.status_policy)


# Shared result tables in dependency order: each is written after those it reads.
SHARED_ORDER = [
    "category_base",                  # F4, R7, R8
    "agg_monthly_kpis",               # F6 -> F7, F8, F9, R1, R2, R6, R9
    "agg_monthly_kpis_enriched",      # F7 -> A55-A61
    "agg_funnel_metrics",             # F5 -> R3, R4
    "agg_daily_funnel",               # A42 -> A43
    "country_cancellation_metrics",   # A6 -> A21, A23, D6
    "country_cart_purchase_funnel",   # A12 -> A21, D6
    "_country_revenue_base",          # A15 -> A16, A17, A21, D6
    "country_performance_summary",    # A21 -> A46, A48
    "_items_per_user_category",       # per user and category -> A4, A19, D9
    "country_segment_metrics",        # A4 -> A5, A20
    "country_month_kpis",             # D4 -> A62
    "_user_revenue",                  # per user of fact_orders -> A49-A52
    "_user_product_revenue",          # per user and product -> A53, A54
]


def materialize_shared(model: Model, root: str | None = None) -> Model:
    """Write the result tables other results read (SHARED_ORDER) below ``root/_shared`` and
    point the model at the written copies, like the layered CTAS model does: F7, F8, F9
    and the seasonality reports then read the stored monthly table, not the item facts. Tables that
    don't wait for each other are written at the same time.
    The stored form keeps decimals, so the readers' arithmetic stays exact."""
    from tillroll.plans.refresh import refresh_results

    refresh_results(model, root or default_root(model.order_items.sparkSession), keys=[], shared=SHARED_ORDER).paths()
    return model


def _month_ranges(months: list[dt.date | None]) -> Column:
    """created_at within any of the calendar months (None: no created_at): plain predicates on
    the stored column, so they reach the parquet scan."""
    cond = F.lit(False)
    for m in months:
        if m is None:
            cond = cond | F.col("created_at").isNull()
            continue
        start = m.replace(day=1)
        end = (start + dt.timedelta(days=32)).replace(day=1)
        from_, to = (F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (start, end))
        cond = cond | (F.col("created_at") >= from_) & (F.col("created_at") < to)
    return cond


def _one_of(col: Column, months: list[dt.date | None]) -> Column:
    known = col.isin([m.replace(day=1) for m in months if m is not None])
    return F.coalesce(known, F.lit(False)) | (col.isNull() if None in months else F.lit(False))


def items_of_months(items: DataFrame, months: list[dt.date | None]) -> DataFrame:
    """The order items of some calendar months (None: those without a time). A layer that is
    partitioned by month is read in those partitions only."""
    rows = items.filter(_month_ranges(months))
    if ITEM_MONTH in items.columns:
        months = [m and m.replace(day=1) for m in months]
        known = F.col(ITEM_MONTH).isin([m for m in months if m is not None])
        rows = rows.filter(known | F.col(ITEM_MONTH).isNull() if None in months else known)
    return rows


def write_monthly_kpis(model: Model, path: str, months: list[dt.date | None] | None = None) -> None:
    """Store F6.  Without ``months`` the whole table is replaced.  With them only those months (None:
    items without a date) are computed again, from their partitions of the items; the other rows, one per
    month, are taken over from the stored table, and both become its next version at once.  A listed month
    that has no row any more loses it.  F7-F9 and the seasonality tables derive from the stored F6."""
    from tillroll.operators.growth import monthly_kpis

    if months is None:
        write_table(monthly_kpis(model.items_with_month(), []), path)
        return
    if not months:
        return
    spark = model.order_items.sparkSession
    changed = Model(model.sources, model.status_policy).use("order_items", items_of_months(model.order_items, months))
    new = monthly_kpis(changed.items_with_month(changed.fact_order_items_all), [])
    kept = read_monthly_kpis(spark, path).filter(~_one_of(F.col("month"), months))
    write_table(kept.unionByName(new), path)


def read_monthly_kpis(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path)


def write_catalog_table(df: DataFrame, database: str, name: str, path: str) -> None:
    """CREATE OR REPLACE TABLE database.name AS ...: the next version of the table at ``path``, to which the
    entry of the session catalog (a metastore on a cluster) is switched at the end."""
    folder = replace_table(df, path)
    switch_catalog_table(df.sparkSession, database, name, folder)


def write_results(model: Model, root: str, keys: list[str] | None = None,
                  database: str | None = None) -> dict[str, str]:
    """Write result tables (all registered keys by default) under ``root/<key>``; with
    ``database``, also register each as the catalog table ``database.<key>``. A table that fails
    stops only those that read it; the error that is then raised names them all."""
    from tillroll.plans.refresh import refresh_results
    return refresh_results(model, root, keys, database).paths()


__all__ = ["ITEM_MONTH", "SHARED_ORDER", "VersionLog", "default_root", "items_of_months", "layer_frames", "materialize",
           "materialize_shared", "read_monthly_kpis", "read_table", "write_catalog_table", "write_monthly_kpis",
           "write_results", "write_table"]
