"""The four canonical inputs and their schemas.

A deployment reads real ``order_items``, ``products``, ``users`` and ``events`` tables;
``load_canonical`` does that with the schema enforced.  Tests and the bench derive the
same four frames from the generated tables (``testdata.load_testdata``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_ITEMS_SCHEMA = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("status", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("sale_price", T.DecimalType(12, 2), True),
])

PRODUCTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("retail_price", T.DecimalType(12, 2), True),
])

USERS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("country", T.StringType(), True),
    T.StructField("gender", T.StringType(), True),
    T.StructField("age", T.IntegerType(), True),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("event_type", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
])

SCHEMAS = {
    "order_items": ORDER_ITEMS_SCHEMA,
    "products": PRODUCTS_SCHEMA,
    "users": USERS_SCHEMA,
    "events": EVENTS_SCHEMA,
}


@dataclass(frozen=True)
class Sources:
    order_items: DataFrame
    products: DataFrame
    users: DataFrame
    events: DataFrame
    #: About how many order items there are, where that is known without a join.
    n_items: int | None = None


def cast_and_check(name: str, given: T.DataType, wanted: T.DataType) -> tuple[Column, Column | None]:
    """``name`` in the declared type, and whether its value stays the same (None: always).

    An instant (a timestamp with a zone) becomes the UTC wall clock whatever the session's zone.
    Columns that have the declared type already stay plain, so filters on them reach the scan."""
    col = F.col(name)
    if given == wanted:
        return col, None
    if isinstance(given, T.TimestampType) and isinstance(wanted, T.TimestampNTZType):
        seconds = (F.unix_micros(col).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        zero = F.lit(0)
        return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds), None
    cast = col.try_cast(wanted)
    return cast, cast.try_cast(given).eqNullSafe(col)


def _lossless(name: str, given: T.DataType, wanted: T.DataType) -> Column:
    """``name`` as the declared type; a value that the cast would change fails the job."""
    cast, same = cast_and_check(name, given, wanted)
    if same is None:
        return cast
    return F.when(same, cast).otherwise(F.raise_error(F.concat(
        F.lit(f"{name}: a value changes when read as {wanted.simpleString()}: "),
        F.coalesce(F.col(name).cast("string"), F.lit("null")))))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, in the declared types; no value may change."""
    return df.select(*[_lossless(f.name, df.schema[f.name].dataType, f.dataType).alias(f.name)
                       for f in schema.fields])


def load_canonical(spark: SparkSession, base: str, fmt: str = "parquet") -> Sources:
    """Read the four canonical tables stored under ``base/<name>``; no value may change."""
    frames = {name: conform(spark.read.format(fmt).load(f"{base}/{name}"), schema)
              for name, schema in SCHEMAS.items()}
    return Sources(**frames)


#: Partition columns of the layer's tables; they are kept, so that filters on them prune files.
LAYER_PARTITIONS = {"order_items": [T.StructField("order_month", T.DateType(), True)]}


def load_layer(spark: SparkSession, folder: str) -> Sources:
    """Read the four tables as the layer stores them: in the canonical types, order items by month."""
    return Sources(**{name: spark.read.schema(T.StructType(schema.fields + LAYER_PARTITIONS.get(name, [])))
                      .parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()})


def from_frames(order_items: DataFrame, products: DataFrame, users: DataFrame,
                events: DataFrame) -> Sources:
    """Wrap in-memory frames (hand fixtures) with the schema enforced."""
    return Sources(conform(order_items, ORDER_ITEMS_SCHEMA), conform(products, PRODUCTS_SCHEMA),
                   conform(users, USERS_SCHEMA), conform(events, EVENTS_SCHEMA))
