"""Means of ratios: exact sums, the same bits however rows are dealt, near the double AVG."""

import random
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.helpers import spark_rows
from tillroll.functions.metrics import cents, exact_mean, pct_2dp, quotient
from tillroll.plans.model import Model
from tillroll.registry import run_query
from tillroll.sources.canonical import Sources

KEYS = ["country_performance_summary", "final_country_performance_v1", "final_country_performance_v2", "seasonality_sign_counts",
        "seasonality_by_country", "category_segments", "seasonality_by_month_number", "seasonality_2020_2025"]


def half_up(x, digits):
    scaled = x * 10**digits
    n = (abs(2 * scaled.numerator) + scaled.denominator) // (2 * scaled.denominator)
    return Fraction(n if scaled >= 0 else -n, 10**digits)


def test_quotients_and_means_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), rng.randrange(-10**6, 10**6), rng.choice([0, None, *range(1, 9999)])) for _ in range(900)]
    df = spark.createDataFrame(rows, "k int, a long, b long")
    got = {r["k"]: r for r in df.groupBy("k").agg(
        exact_mean(quotient(F.col("a"), F.col("b"))).alias("m"),
        exact_mean(quotient(F.col("a"), F.col("b"))).cast("double").alias("d"),
        pct_2dp(exact_mean(quotient(F.col("a"), F.col("b")))).alias("pct"),
        F.avg(F.try_divide(F.col("a").cast("double"), F.col("b").cast("double"))).alias("plain")).collect()}
    for k, r in got.items():
        q = [half_up(Fraction(a, b), 18) for kk, a, b in rows if kk == k and b]
        want = half_up(sum(q) / len(q), 18)
        assert Fraction(r["m"]) == want
        assert r["d"] == float(want)
        assert r["pct"] == float(half_up(want, 4) * 100)
        assert r["d"] == pytest.approx(r["plain"], rel=1e-12)


def test_no_rows_and_no_quotients(spark):
    df = spark.createDataFrame([(1, 0), (1, None)], "a long, b long")
    assert df.agg(exact_mean(quotient(F.col("a"), F.col("b"))).cast("double").alias("m")).first()["m"] is None
    assert spark.createDataFrame([(Decimal("12.34"),)], "x decimal(12,2)").select(cents(F.col("x")).alias("c")).first()["c"] == 1234


@pytest.mark.parametrize("key", KEYS)
def test_the_same_bits_with_3_and_37_partitions(spark, small_model, key):
    src = small_model.sources
    old = spark.conf.get("spark.sql.shuffle.partitions")
    got = []
    try:
        for n in (3, 37):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            m = Model(Sources(src.order_items.repartition(n), src.products, src.users, src.events))
            got.append(spark_rows(run_query(key, m)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[0] == got[1]


def test_neither_side_rounds_a_mean():
    import inspect

    from tillroll import oracle
    from tillroll.operators import category, geography, seasonality
    for key in KEYS:
        assert "ROUND(" not in oracle.STATEMENTS[key]
    for fn in (geography.country_performance_summary, seasonality.seasonality_sign_counts, seasonality.seasonality_by_country,
               category.category_segments):
        assert "round" not in inspect.getsource(fn).lower()
