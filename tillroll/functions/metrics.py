"""Column expressions shared by the dashboard jobs.

Everything here is a built-in Spark expression, so it stays inside whole-stage codegen.

Numeric conventions (they make results independent of partitioning and shuffle order):

* money is ``DECIMAL(12,2)`` per item; sums stay decimal, hence exact;
* ratios are ``try_divide`` on doubles: NULL when the divisor is 0 or NULL;
* ratios rounded to n digits are divided in decimal and rounded HALF_UP (half away from
  zero for the non-negative values they take), never by rounding a double;
* means of ratios are sums of decimal quotients, which are exact in any order, divided and cast
  to DOUBLE once (``exact_mean``);
* logarithms, powers and spreads are reported to ``MEAN_DIGITS`` decimals (``MONEY_MEAN_DIGITS``
  for money-sized values), because sums of doubles depend on the order partitions are merged in.
"""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Order-item status names.
PROCESSING, SHIPPED, COMPLETE, CANCELLED, RETURNED = (
    "Processing", "Shipped", "Complete", "Cancelled", "Returned")
# Statuses counted as commercially valid revenue.
VALID_STATUSES = (PROCESSING, SHIPPED, COMPLETE)

MEAN_DIGITS = 10        # logarithms and powers (magnitude about 1): ~10 significant digits
MONEY_MEAN_DIGITS = 6   # spreads in money units (up to ~1e6): ~12 significant digits


class StatusPolicy(str, Enum):
    """Which order items count as revenue; the statements use three definitions."""

    VALID = "valid"                  # Processing, Shipped, Complete
    NOT_CANCELLED = "not_cancelled"  # status != 'Cancelled' (Returned counts, NULL drops)
    COMPLETE = "complete"            # status = 'Complete'


def status_in_policy(status: Column, policy: StatusPolicy) -> Column:
    """Predicate with SQL three-valued logic (a NULL status is never TRUE)."""
    policy = StatusPolicy(policy)
    if policy is StatusPolicy.VALID:
        return status.isin(*VALID_STATUSES)
    if policy is StatusPolicy.NOT_CANCELLED:
        return status != F.lit(CANCELLED)
    return status == F.lit(COMPLETE)


def safe_divide(num: Column, den: Column) -> Column:
    """Float division, NULL when den is 0 or either side is NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_ratio(num: Column, den: Column, digits: int, *, money: bool = False) -> Column:
    """ROUND(SAFE_DIVIDE(num, den), digits) computed exactly, as DOUBLE.

    ``num`` is a decimal money sum (``money=True``) or an integer count; ``den`` an integer
    count.  The quotient is taken in decimal with 18 fractional digits and then rounded
    HALF_UP, so no binary rounding error can move a value across a half-cent.
    """
    n = num.cast("decimal(22,2)") if money else num.cast("decimal(20,0)")
    q = F.try_divide(n, den.cast("decimal(20,0)"))
    return F.round(q, digits).cast("double")


def cents(money: Column) -> Column:
    """Money as a whole number of cents."""
    return (money * F.lit(100)).cast("decimal(20,0)")


def quotient(num: Column, den: Column) -> Column:
    """num / den of whole numbers as a decimal with 18 fractional digits; NULL when den is 0."""
    return F.try_divide(num.cast("decimal(20,0)"), den.cast("decimal(20,0)"))


def exact_mean(q: Column, over: Callable[[Column], Column] = lambda c: c) -> Column:
    """AVG of quotients, as a decimal with 18 fractional digits: the sum is exact, so its value does
    not depend on the order in which partitions are merged. Cast it to DOUBLE once, at the end.
    ``over`` may put the sum and the count over a window."""
    return F.try_divide(over(F.sum(q)), over(F.count(q)).cast("decimal(20,0)"))


def pct_2dp(mean: Column, scale: int = 100) -> Column:
    """ROUND(mean * scale, 2) of an exact mean, for a scale of 1 or 100."""
    digits = {1: 2, 100: 4}[scale]
    return (F.round(mean, digits) * F.lit(scale)).cast("double")


def count_flagged(rows: DataFrame, keys: list[str], entity: str, flags: dict[str, Column],
                  sums: dict[str, Column] | None = None) -> DataFrame:
    """Per ``keys``: for each flag the distinct non-NULL values of ``entity`` with a row for which
    it holds, and ``sums`` over all rows.

    Rows are reduced to one per (keys, entity) with the flags or-ed, then flags are counted: no
    copy of a row per distinct count, and partial aggregates collapse a hot key or entity
    before the shuffle."""
    sums = sums or {}
    one = rows.groupBy(*keys, entity).agg(
        *[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
        *[F.sum(c).alias(n) for n, c in sums.items()])
    return one.groupBy(*keys).agg(
        *[F.count_if(F.col(n) & F.col(entity).isNotNull()).alias(n) for n in flags],
        *[F.sum(n).alias(n) for n in sums])


def join_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of two tables with one row per group; NULL is a group."""
    other = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, on)).drop(*[f"_{k}" for k in keys])


def month_start(d: Column) -> Column:
    """DATE_TRUNC(date, MONTH) as a DATE."""
    return F.trunc(d, "MM")


def standardize_country(country: Column, mapping: dict[str, tuple[str, ...]]) -> Column:
    """CASE WHEN country IN (variants) THEN standard ... ELSE country END."""
    expr = None
    for standard, variants in mapping.items():
        cond = country.isin(*variants)
        expr = F.when(cond, F.lit(standard)) if expr is None else expr.when(cond, F.lit(standard))
    return country if expr is None else expr.otherwise(country)


def age_group(age: Column) -> Column:
    """Age bands; NULL and ages under 16 fall to 'Unknown'."""
    # Band bounds and labels.
    return (F.when(age.between(16, 24), "16-24")
            .when(age.between(25, 34), "25-34")
            .when(age.between(35, 44), "35-44")
            .when(age.between(45, 54), "45-54")
            .when(age >= 55, "55+")
            .otherwise("Unknown"))


def present(df: DataFrame) -> DataFrame:
    """Output form of a result table: money decimals as DOUBLE, integers as BIGINT."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def attach_total(df: DataFrame, total: DataFrame, name: str) -> DataFrame:
    """Add the single value of a one-row aggregate ``total`` (column ``name``) to every row
    of ``df``, a small per-group table.  Done as a grand-total window over the union, so
    there is no cartesian join; the window partition holds len(df) + 1 rows."""
    other = list(df.columns)
    left = df.select(*[F.col(c) for c in other], F.lit(None).cast(total.schema[name].dataType)
                     .alias("_total"), F.lit(False).alias("_is_total"))
    right = total.select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in other],
                         F.col(name).alias("_total"), F.lit(True).alias("_is_total"))
    both = left.unionByName(right)
    both = both.withColumn(name, F.max("_total").over(Window.partitionBy()))
    return both.filter(~F.col("_is_total")).drop("_total", "_is_total")
