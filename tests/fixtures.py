"""Hand fixtures (FIXTURES.md §4): a few canonical rows each, for what the generated
tables cannot show.  They are combined into one small edge dataset; the comments name the
fixture each row serves."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D
from functools import partial

import duckdb

from tillroll.sources.canonical import (
    EVENTS_SCHEMA,
    ORDER_ITEMS_SCHEMA,
    PRODUCTS_SCHEMA,
    USERS_SCHEMA,
    Sources,
)

d = partial(dt.datetime, hour=9, minute=30)
ts = dt.datetime

PRODUCTS = [
    (1, "Jeans", "B1", "Slim", D("50.00")),
    (2, "Jeans", "B1", "Wide", D("60.00")),
    (3, "Tops", "B2", "Tee", D("20.00")),
    (4, "Tops", "B3", "Polo", D("35.50")),
    (5, "Shoes", "B2", "Run", None),
    # product 99 is missing: orphan_product
]

USERS = [
    (1, "Spain", "F", 15),          # country_variants, age_edges
    (2, "España", "M", 16),
    (3, "Brasil", None, 24),
    (4, "Brazil", "F", 25),
    (5, "Deutschland", "M", 34),
    (6, "Germany", "F", 35),
    (7, "United States", "M", 44),  # two_countries_series
    (8, "China", "F", 45),
    (9, "United States", None, 54),
    (10, "China", "M", 55),
    (11, "Brazil", "F", None),
    (12, "France", "M", 70),        # user_no_items (events only: fanout)
    (13, None, "F", 30),
]

ORDER_ITEMS = [
    # January 2021
    (100, 1, 1, "Complete", d(2021, 1, 5), D("10.00")),     # multi_category_order
    (100, 1, 3, "Complete", d(2021, 1, 5), D("20.00")),
    (101, 2, 2, "Shipped", d(2021, 1, 10), D("30.05")),     # duplicate_item
    (101, 2, 2, "Shipped", d(2021, 1, 10), D("30.05")),
    (102, 3, 99, "Processing", d(2021, 1, 15), D("15.00")),  # orphan_product
    (103, 4, 4, "Cancelled", d(2021, 1, 20), D("40.00")),
    # February (March has no item: month_gap)
    (104, 5, 1, "Returned", d(2021, 2, 2), D("50.00")),
    (105, 6, 3, None, d(2021, 2, 3), D("12.34")),           # status_mix: NULL status
    (123, 2, 3, "Processing", d(2021, 2, 15), D("8.00")),
    # April: revenue 20.01 over two orders and two users -> 10.005 (round_ties)
    (107, 8, 1, "Complete", d(2021, 4, 1), D("10.01")),
    (108, 9, 3, "Complete", d(2021, 4, 2), D("10.00")),
    (124, 6, 4, "Complete", d(2021, 5, 10), D("10.00")),
    (109, 10, 2, "Complete", d(2021, 5, 30), D("25.00")),   # order_two_months
    (109, 10, 3, "Complete", d(2021, 7, 1), D("25.00")),
    # June: zero revenue; July follows it (zero_denominator)
    (110, 11, 1, "Complete", d(2021, 6, 1), D("0.00")),
    (111, 11, 3, "Shipped", d(2021, 7, 1), D("5.00")),
    # August: all cancelled, dropped from the monthly KPIs
    (112, 7, 4, "Cancelled", d(2021, 8, 1), D("9.99")),
    # September-January: falling, flat, rising (negative_growth), interleaved countries
    (113, 7, 1, "Complete", d(2021, 9, 3), D("100.00")),
    (114, 8, 2, "Complete", d(2021, 10, 3), D("50.00")),
    (115, 9, 3, "Complete", d(2021, 11, 3), D("50.00")),
    (116, 10, 4, "Complete", d(2021, 12, 3), D("80.00")),
    (117, 7, 1, "Complete", d(2022, 1, 4), D("70.00")),
    # user_null
    (118, None, 1, "Complete", d(2021, 9, 10), D("5.00")),
    (119, None, 4, "Cancelled", d(2021, 9, 11), D("3.00")),
    # null_created_at
    (120, 4, 3, "Complete", None, D("7.00")),
    # 2020, for the yearly series
    (121, 4, 2, "Complete", d(2020, 12, 15), D("11.00")),
    (122, 1, 1, "Processing", d(2020, 11, 15), D("9.00")),
    (125, 13, 5, "Complete", d(2020, 11, 20), D("4.50")),
]

EVENTS = [
    (1, 8, "s8-a", "product", ts(2021, 1, 5, 10, 0)),      # fanout: 3 events x 2 items
    (2, 8, "s8-a", "cart", ts(2021, 1, 5, 10, 5)),
    (3, 8, "s8-a", "purchase", ts(2021, 1, 5, 10, 10)),
    (4, 8, "s8-b", "purchase", ts(2021, 1, 20, 9, 0)),     # funnel_repeat_user
    (5, None, "s-anon", "product", ts(2021, 1, 6, 11, 0)),  # user_null
    (6, None, "s-anon2", "cart", ts(2021, 2, 7, 12, 0)),    # funnel_gaps: carts, no views
    (7, 12, "s12", "product", ts(2021, 3, 1, 8, 0)),        # funnel_gaps: views, no carts
    (8, 12, "s12", "home", ts(2021, 3, 1, 8, 1)),
    (9, 3, "s3", "product", ts(2021, 4, 2, 10, 0)),
    (10, 3, "s3", "product", ts(2021, 4, 2, 10, 1)),
    (11, 3, "s3", "cart", ts(2021, 4, 2, 10, 2)),
    (12, None, "s-null-ts", "product", None),               # null_created_at
    (13, 7, "s7", "purchase", ts(2021, 9, 3, 0, 0)),
    (14, 7, "s7", "product", ts(2021, 9, 3, 0, 0)),
    (15, 2, "s2", "cancel", ts(2021, 1, 10, 0, 0)),
    (16, None, "s-p", "purchase", ts(2021, 5, 5, 0, 0)),    # a day with an anonymous buyer
]

TABLES = {
    "order_items": (ORDER_ITEMS, ORDER_ITEMS_SCHEMA),
    "products": (PRODUCTS, PRODUCTS_SCHEMA),
    "users": (USERS, USERS_SCHEMA),
    "web_events": (EVENTS, EVENTS_SCHEMA),
}

DUCK_TYPES = {
    "order_items": "order_id BIGINT, user_id BIGINT, product_id BIGINT, status VARCHAR, "
                   "created_at TIMESTAMP, sale_price DECIMAL(12,2)",
    "products": "id BIGINT, category VARCHAR, brand VARCHAR, name VARCHAR, "
                "retail_price DECIMAL(12,2)",
    "users": "id BIGINT, country VARCHAR, gender VARCHAR, age INTEGER",
    "web_events": "id BIGINT, user_id BIGINT, session_id VARCHAR, event_type VARCHAR, "
                  "created_at TIMESTAMP",
}


def spark_sources(spark, tables=None) -> Sources:
    tables = tables or TABLES
    frames = {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()}
    return Sources(frames["order_items"], frames["products"], frames["users"],
                   frames["web_events"])


def duck_con(tables=None):
    tables = tables or TABLES
    con = duckdb.connect()
    for name, (rows, _) in tables.items():
        con.execute(f"CREATE TABLE {name} ({DUCK_TYPES[name]})")
        if rows:
            marks = ", ".join("?" * len(rows[0]))
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows)
    return con
