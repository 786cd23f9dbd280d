"""Left joins whose key is often NULL or held by few values.

A shuffle join sends all rows of a key to one task, and all rows without a key to another. Here
such rows get a salt, so they are dealt over many tasks; of the other side only the rows of hot
keys are copied, once per salt. It is one scan and one shuffle of each side, needs no broadcast
and works with adaptive execution off.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than one of this many rows, so there are never more hot keys than that.
HOT_SHARE = 2000
#: Salts per shuffle partition that a key fills by itself: enough small parts to fill partitions evenly.
PARTS = 8
#: Salts of rows without a key, which need no partner.
FREE = 1 << 20
#: Rows per task where many rows are joined or grouped, so that a task's memory does not grow with the input.
ROWS_PER_TASK = 250_000
#: Up to this many rows, Spark's own number of tasks will do.
FEW_ROWS = 1_000_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """The number of tasks that join or group so many rows; None: left to Spark."""
    return max(-(-rows // ROWS_PER_TASK), spark.sparkContext.defaultParallelism) if rows > FEW_ROWS else None


def deal(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over that many tasks. A number that is asked for is not lowered by adaptive
    execution, which else makes as few tasks as there are cores, of up to 64 MB of compressed rows each."""
    return df.repartition(tasks, *keys) if tasks else df


def find_hot_keys(rows: DataFrame, key: str) -> dict:
    """The values of ``key`` that hold more than one in ``HOT_SHARE`` of the rows, with their share,
    from counts of all rows: HOT_SHARE values at most."""
    total = rows.count()
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") * HOT_SHARE > total).collect()
    return {r[key]: r["n"] / total for r in top}


def spread_left_join(rows: DataFrame, other: DataFrame, key: str, hot: Mapping, by: Sequence[str]) -> DataFrame:
    """``rows`` LEFT JOIN ``other`` on ``key``; rows without a key, and those of the ``hot`` keys, are
    dealt by a hash of the columns ``by``. A hot key gets as many salts as it would fill partitions,
    times ``PARTS``, so all hot keys together are copied about that often times the partitions."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    classes: dict[int, list] = {}  # salts, a power of two -> keys
    for value, share in hot.items():
        salts = 1 << max(0, int(share * partitions * PARTS)).bit_length()
        classes.setdefault(salts, []).append(value)
    spread, col = F.xxhash64(*by), F.col(key)

    def dealt(salts: int) -> Column:
        return F.pmod(spread, F.lit(salts)).cast("int")

    own, copies = F.when(col.isNull(), dealt(FREE)), F.array(F.lit(0))
    for salts, values in classes.items():
        own = own.when(col.isin(values), dealt(salts))
        copies = F.when(col.isin(values), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(copies)
    left = rows.withColumn("_salt", own.otherwise(F.lit(0)))
    right = other.filter(col.isNotNull()).withColumn("_salt", F.explode(copies))
    return left.join(right, [key, "_salt"], "left").drop("_salt")
