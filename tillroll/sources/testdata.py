"""Canonical inputs derived from the generated TPC-H-style tables.

The generated data has no retail schema; these deterministic rules give it one
(documented in FIXTURES.md §3).  Only the columns a rule needs are read, so the
parquet scans prune to them, and every rule is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.joins import deal, tasks_for
from tillroll.sources.canonical import (
    EVENTS_SCHEMA,
    ORDER_ITEMS_SCHEMA,
    PRODUCTS_SCHEMA,
    USERS_SCHEMA,
    Sources,
    conform,
)

# Months added to order dates so that orders overlap the event period.
ORDER_DATE_SHIFT_MONTHS = 270
# Nation key -> country spelling (variants on purpose); others keep n_name.
NATION_COUNTRY = {
    0: "Spain", 1: "España", 2: "Brasil", 3: "Brazil", 4: "Germany",
    5: "Deutschland", 6: "United States", 7: "China",
}
# Generated event type -> canonical event type.
EVENT_TYPE = {"view": "product", "click": "cart", "purchase": "purchase",
              "signup": "home", "error": "cancel"}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status(flag: Column, line: Column) -> Column:
    # Fixed values: (returnflag, linestatus) -> status.
    return (F.when(flag == "R", "Returned")
            .when((flag == "A") & (line == "F"), "Cancelled")
            .when((flag == "A") & (line == "O"), "Processing")
            .when((flag == "N") & (line == "F"), "Complete")
            .when((flag == "N") & (line == "O"), "Shipped"))


def order_items(spark: SparkSession, sf_dir: str, n_items: int) -> DataFrame:
    tasks = tasks_for(spark, n_items)
    li = deal(_read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus"), tasks, "l_orderkey")
    orders = deal(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), tasks, "o_orderkey")
    joined = li.join(orders, li.l_orderkey == orders.o_orderkey, "inner")
    return conform(joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"),
        _status(F.col("l_returnflag"), F.col("l_linestatus")).alias("status"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_ym_interval(
            F.lit(0), F.lit(ORDER_DATE_SHIFT_MONTHS))).alias("created_at"),
        F.col("l_extendedprice").alias("sale_price"),
    ), ORDER_ITEMS_SCHEMA)


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return conform(part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("retail_price"),
    ), PRODUCTS_SCHEMA)


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    country = None
    for key, name in NATION_COUNTRY.items():
        cond = F.col("n_nationkey") == key
        country = F.when(cond, name) if country is None else country.when(cond, name)
    key = F.col("c_custkey")
    joined = cust.join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
    return conform(joined.select(
        key.alias("id"),
        country.otherwise(F.col("n_name")).alias("country"),
        F.when(key % 3 == 0, "F").when(key % 3 == 1, "M").alias("gender"),
        F.when(key % 11 == 0, F.lit(None)).otherwise(10 + (key * 37) % 65).alias("age"),
    ), USERS_SCHEMA)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    shifted = F.col("ts") - F.make_ym_interval(F.lit(0), (F.col("event_id") % 24).cast("int"))
    ev = ev.withColumn("created_at", shifted)
    etype = None
    for src, dst in EVENT_TYPE.items():
        cond = F.col("event_type") == src
        etype = F.when(cond, dst) if etype is None else etype.when(cond, dst)
    return conform(ev.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.to_date("created_at").cast("string")).alias("session_id"),
        etype.alias("event_type"),
        F.col("created_at"),
    ), EVENTS_SCHEMA)


def load_testdata(spark: SparkSession, sf_dir: str) -> Sources:
    """The four canonical frames over ``sf_dir/<table>.parquet``."""
    n_items = _read(spark, sf_dir, "lineitem").count()  # read from the files' footers
    return Sources(order_items(spark, sf_dir, n_items), products(spark, sf_dir),
                   users(spark, sf_dir), events(spark, sf_dir), n_items)
