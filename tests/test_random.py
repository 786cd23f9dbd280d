"""Randomised differential test: seeded canonical datasets with NULLs in every nullable
column, orphan keys, duplicates and ties; every key must equal its DuckDB statement."""

import datetime as dt
import os
import random
from decimal import Decimal

import duckdb
import pytest

from tests.helpers import assert_same, duck_rows, spark_rows
from tillroll.oracle import STATEMENTS, on_canonical
from tillroll.plans.model import Model
from tillroll.registry import QUERIES, run_query
from tillroll.sources.canonical import (
    EVENTS_SCHEMA,
    ORDER_ITEMS_SCHEMA,
    PRODUCTS_SCHEMA,
    USERS_SCHEMA,
    Sources,
)

# More seeds: TILLROLL_RANDOM_SEEDS=7,2024,99 python -m pytest tests/test_random.py
SEEDS = [int(x) for x in os.environ.get("TILLROLL_RANDOM_SEEDS", "7").split(",")]
STATUSES = ["Complete", "Shipped", "Processing", "Cancelled", "Returned", None]
COUNTRIES = ["Spain", "España", "Brasil", "Brazil", "Germany", "Deutschland",
             "United States", "China", "France", None]


def _maybe(rng, value, p):
    return None if rng.random() < p else value


def dataset(seed):
    rng = random.Random(seed)
    products = [(p, _maybe(rng, f"cat{rng.randrange(6)}", 0.05),
                 _maybe(rng, f"brand{rng.randrange(5)}", 0.05),
                 _maybe(rng, f"name{rng.randrange(12)}", 0.05),
                 _maybe(rng, Decimal(rng.randrange(100, 9999)) / 100, 0.1))
                for p in range(1, 31)]
    users = [(u, _maybe(rng, rng.choice(COUNTRIES), 0.0), _maybe(rng, rng.choice("FM"), 0.2),
              _maybe(rng, rng.randrange(10, 80), 0.15)) for u in range(1, 41)]
    items = []
    for i in range(900):
        order = rng.randrange(1, 260)
        day = dt.datetime(2019, 11, 1) + dt.timedelta(minutes=rng.randrange(0, 1100 * 24 * 60))
        items.append((order, _maybe(rng, rng.randrange(1, 46), 0.05),   # users 41-45 unknown
                      _maybe(rng, rng.randrange(1, 34), 0.03),           # products 31-33 orphan
                      rng.choice(STATUSES), _maybe(rng, day, 0.03),
                      _maybe(rng, Decimal(rng.randrange(0, 50000)) / 100, 0.03)))
    items += items[:25]                                                  # exact duplicates
    events = []
    for e in range(700):
        t = dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 900))
        user = _maybe(rng, rng.randrange(1, 46), 0.2)
        events.append((e, user, _maybe(rng, f"s{user}-{t.date()}", 0.02),
                       rng.choice(["product", "cart", "purchase", "home", "cancel"]),
                       _maybe(rng, t, 0.02)))
    return {"order_items": items, "products": products, "users": users, "web_events": events}


DUCK = {
    "order_items": "order_id BIGINT, user_id BIGINT, product_id BIGINT, status VARCHAR, "
                   "created_at TIMESTAMP, sale_price DECIMAL(12,2)",
    "products": "id BIGINT, category VARCHAR, brand VARCHAR, name VARCHAR, "
                "retail_price DECIMAL(12,2)",
    "users": "id BIGINT, country VARCHAR, gender VARCHAR, age INTEGER",
    "web_events": "id BIGINT, user_id BIGINT, session_id VARCHAR, event_type VARCHAR, "
                  "created_at TIMESTAMP",
}


@pytest.fixture(scope="module", params=SEEDS)
def case(request, spark):
    data = dataset(request.param)
    src = Sources(spark.createDataFrame(data["order_items"], ORDER_ITEMS_SCHEMA),
                  spark.createDataFrame(data["products"], PRODUCTS_SCHEMA),
                  spark.createDataFrame(data["users"], USERS_SCHEMA),
                  spark.createDataFrame(data["web_events"], EVENTS_SCHEMA))
    con = duckdb.connect()
    for name, rows in data.items():
        con.execute(f"CREATE TABLE {name} ({DUCK[name]})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return Model(src), con


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_random_dataset_matches_oracle(case, key):
    model, con = case
    assert_same(spark_rows(run_query(key, model)),
                duck_rows(con, on_canonical(STATEMENTS[key])), key)
