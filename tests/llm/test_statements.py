"""Queries that SQL can express equal their statements on the given tables."""

import duckdb
import pytest

from tests.helpers import assert_same, duck_rows, spark_rows
from tillroll.llm.queries import ORACLE_SQL, QUERIES

from .conftest import SF


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_equals_its_statement(spark, key):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    assert_same(spark_rows(QUERIES[key](spark, SF)), duck_rows(con, ORACLE_SQL[key]), key)
