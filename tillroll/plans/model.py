"""The star-schema layer: facts and dimensions every dashboard table reads.

Each property is a lazily planned DataFrame.  Nothing is cached here: Catalyst prunes
columns and pushes filters through these projections into the parquet scans, so a query
reading two columns of a fact scans two columns.  To share the layer across many queries,
``plans.warehouse.materialize`` writes it once and returns a Model over the written tables.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.countries import COUNTRY_MAP_DIM_USER
from tillroll.functions.joins import find_hot_keys, tasks_for
from tillroll.functions.metrics import (
    StatusPolicy,
    age_group,
    month_start,
    standardize_country,
    status_in_policy,
)
from tillroll.sources.canonical import Sources
from tillroll.sources.testdata import load_testdata

# Canonical event types of the funnel.
PRODUCT_VIEW, CART, PURCHASE = "product", "cart", "purchase"

# Result tables that other result tables read, by name (filled by ``@shared``).
SHARED: dict = {}


def shared(fn):
    """Mark an operator whose result several others read.

    The Model keeps one plan per name, and a refresh run may replace it with the table it
    has written (``plans.warehouse.materialize_shared``), so the readers start from a small
    stored table instead of re-aggregating the facts - the layered CTAS model's boundary.
    """
    name = fn.__name__

    @functools.wraps(fn)
    def wrapper(m: "Model", *args, **kwargs):
        if args or kwargs:
            return fn(m, *args, **kwargs)
        return m._get(f"shared:{name}", lambda: fn(m))

    SHARED[name] = wrapper
    return wrapper


class Model:
    """Sources plus the derived layer.  ``fact_order_items`` follows ``status_policy``."""

    def __init__(self, sources: Sources, status_policy: StatusPolicy = StatusPolicy.VALID,
                 layer: dict[str, DataFrame] | None = None):
        self.sources = sources
        self.status_policy = StatusPolicy(status_policy)
        # Pre-built (materialised) tables override the lazily derived ones.
        self._layer = dict(layer or {})

    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str, **kw) -> "Model":
        return cls(load_testdata(spark, sf_dir), **kw)

    def _get(self, name: str, build):
        if name not in self._layer:
            self._layer[name] = build()
        return self._layer[name]

    def use(self, name: str, df: DataFrame | None) -> "Model":
        """Serve table ``name`` (a layer property or a ``@shared`` operator's name) from
        ``df``, typically a stored copy; None forgets it, so it is planned again."""
        key = name if hasattr(type(self), name) else f"shared:{name}"
        if df is None:
            self._layer.pop(key, None)
        else:
            self._layer[key] = df
        return self

    # raw sources -------------------------------------------------------------------
    @property
    def order_items(self) -> DataFrame:
        return self._get("order_items", lambda: self.sources.order_items)

    @property
    def products(self) -> DataFrame:
        return self.sources.products

    @property
    def users(self) -> DataFrame:
        return self.sources.users

    @property
    def events(self) -> DataFrame:
        return self.sources.events

    # F1-F3 -------------------------------------------------------------------------
    @property
    def fact_order_items_all(self) -> DataFrame:
        """one row per order item; order_date is the calendar date."""
        return self._get("fact_order_items_all", lambda: self.order_items.select(
            "user_id", "product_id", "order_id",
            F.to_date("created_at").alias("order_date"),
            F.col("sale_price").alias("revenue"),
            "status"))

    @property
    def fact_order_items_completed(self) -> DataFrame:
        """items with a commercially valid status (Processing, Shipped, Complete)."""
        return self._get("fact_order_items_completed", lambda: self.fact_order_items_all.filter(
            status_in_policy(F.col("status"), StatusPolicy.VALID)))

    @property
    def dim_product(self) -> DataFrame:
        """F3."""
        return self._get("dim_product", lambda: self.products.select(
            F.col("id").alias("product_id"),
            F.col("category").alias("product_category"),
            "brand",
            F.col("name").alias("product_name"),
            "retail_price"))

    # D1, D2 ------------------------------------------------------------------------
    @property
    def fact_order_items(self) -> DataFrame:
        """F1 under the model's status policy (default: valid statuses, = F2)."""
        if self.status_policy is StatusPolicy.VALID:
            return self.fact_order_items_completed
        return self.fact_order_items_all.filter(
            status_in_policy(F.col("status"), self.status_policy))

    @property
    def fact_orders(self) -> DataFrame:
        """Distinct (order_id, user_id) of fact_order_items."""
        return self._get("fact_orders",
                         lambda: self.fact_order_items.select("order_id", "user_id").distinct())

    # A2 ----------------------------------------------------------------------------
    @property
    def dim_user(self) -> DataFrame:
        """A2: standardised country (Spain, Brazil), gender default, age band."""
        return self._get("dim_user", lambda: self.users.select(
            F.col("id").alias("user_id"),
            standardize_country(F.col("country"), COUNTRY_MAP_DIM_USER).alias("country"),
            F.coalesce(F.col("gender"), F.lit("Unknown")).alias("gender"),
            age_group(F.col("age")).alias("age_group")))

    # A3, A13, A39 ------------------------------------------------------------------
    def _identified_events(self, types: tuple[str, ...]) -> DataFrame:
        return self.events.filter(
            F.col("event_type").isin(*types) & F.col("user_id").isNotNull()).select(
            "user_id", F.to_date("created_at").alias("event_date"), "event_type")

    @property
    def fact_events_v1(self) -> DataFrame:
        """A3: identified product and purchase events."""
        return self._get("fact_events_v1",
                         lambda: self._identified_events((PRODUCT_VIEW, PURCHASE)))

    @property
    def fact_events_v2(self) -> DataFrame:
        """Identified product, cart and purchase events."""
        return self._get("fact_events_v2",
                         lambda: self._identified_events((PRODUCT_VIEW, CART, PURCHASE)))

    @property
    def fact_events_all(self) -> DataFrame:
        """Funnel events with anonymous users kept."""
        return self._get("fact_events_all", lambda: self.events.filter(
            F.col("event_type").isin(PRODUCT_VIEW, CART, PURCHASE)).select(
            F.col("id").alias("event_id"), "user_id", "session_id", "event_type",
            "created_at", F.to_date("created_at").alias("event_date")))

    # helpers -----------------------------------------------------------------------
    def hot_keys(self, key: str) -> dict:
        """The users or products that hold a large share of the order items, with their share
        (``functions.joins``); counted once per model."""
        return self._get(f"hot:{key}", lambda: find_hot_keys(self.order_items.select(key), key))

    @property
    def item_tasks(self) -> int | None:
        """How many tasks join or group the order items (``functions.joins.tasks_for``); counted once per model."""
        def count() -> int | None:
            rows = self.sources.n_items
            return tasks_for(self.sources.order_items.sparkSession, self.order_items.count() if rows is None else rows)

        return self._get("item_tasks", count)

    def items_with_month(self, df: DataFrame | None = None) -> DataFrame:
        """F1 (or a filtered copy) with its calendar month."""
        df = self.fact_order_items_all if df is None else df
        return df.withColumn("month", month_start(F.col("order_date")))

    def raw_items_with_month(self) -> DataFrame:
        """Raw order_items with DATE_TRUNC(DATE(created_at), MONTH)."""
        return self.order_items.withColumn(
            "month", month_start(F.to_date("created_at")))
