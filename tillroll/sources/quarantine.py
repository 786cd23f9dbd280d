"""Reading canonical tables that hold bad values: good rows on, rejected rows to quarantine.

Each table is read once and written once, good and rejected rows in partitions of their own: good
rows in the declared types, rejected rows as they came (JSON) with the column and reason of every
fault. The split becomes current by one commit, and only if no table loses more than a given share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.versions import VersionLog
from tillroll.sources.canonical import SCHEMAS, Sources, cast_and_check

_FAULTS = T.ArrayType(T.StructType([T.StructField("column", T.StringType()), T.StructField("reason", T.StringType())]))
_EXTRA = [T.StructField("faults", _FAULTS), T.StructField("raw", T.StringType()), T.StructField("is_rejected", T.BooleanType())]


class TooManyRejected(ValueError):
    """More rows than allowed have bad values; the split does not become current."""


@dataclass(frozen=True)
class Split:
    sources: Sources
    #: source, raw (the row as JSON), faults (column and reason)
    rejected: DataFrame
    #: table -> (rows, rejected rows)
    counts: dict[str, tuple[int, int]]


def annotate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns (NULL where a value is bad) with ``faults``, ``raw`` and ``is_rejected``. A
    missing column is an error of the table, not of its rows."""
    typed, faults = [], []

    def fault(name: str, cond: Column, reason: str) -> Column:
        return F.when(cond, F.struct(F.lit(name).alias("column"), F.lit(reason).alias("reason")))

    for f in schema.fields:
        if f.name not in df.columns:
            raise ValueError(f"column {f.name} is missing")
        cast, same = cast_and_check(f.name, df.schema[f.name].dataType, f.dataType)
        if same is not None:
            faults.append(fault(f.name, ~same, f"changes when read as {f.dataType.simpleString()}"))
            cast = F.when(same, cast)
        if not f.nullable:
            faults.append(fault(f.name, F.col(f.name).isNull(), "is null"))
        typed.append(cast.alias(f.name))
    held = F.filter(F.array(*faults), lambda x: x.isNotNull()) if faults else F.array().cast(_FAULTS)
    bad = F.size(held) > 0
    raw = F.when(bad, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}))
    return df.select(*typed, held.alias("faults"), raw.alias("raw"), bad.alias("is_rejected"))


def split_canonical(spark: SparkSession, base: str, out: str, max_rejected: float = 0.01, fmt: str = "parquet") -> Split:
    """Splits the four tables under ``base/<name>`` into the next version at ``out``. Fails, with the old
    version kept, if more than ``max_rejected`` of a table's rows have faults."""
    log = VersionLog(spark, out)
    folder = log.new_folder()
    counts: dict[str, tuple[int, int]] = {}
    for name, schema in SCHEMAS.items():
        seen = Observation(f"split {name}")
        rows = annotate(spark.read.format(fmt).load(f"{base}/{name}"), schema)
        rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("is_rejected").alias("rejected")).write.partitionBy(
            "is_rejected").parquet(f"{folder}/{name}")
        counts[name] = (seen.get["rows"], seen.get["rejected"])
    lost = [f"{name}: {bad} of {n} rows" for name, (n, bad) in counts.items() if bad > max_rejected * n]
    if lost:
        raise TooManyRejected("; ".join(lost))
    log.commit({"folders": [folder], "counts": counts})
    log.expire()
    return current_split(spark, out)


def current_split(spark: SparkSession, out: str) -> Split:
    commit = VersionLog(spark, out).latest()
    if commit is None:
        raise FileNotFoundError(f"{out}: no version was committed")
    good, rejected = {}, None
    for name, schema in SCHEMAS.items():
        rows = spark.read.schema(T.StructType(schema.fields + _EXTRA)).parquet(f"{commit.entry['folders'][0]}/{name}")
        good[name] = rows.filter("not is_rejected").select(*schema.fieldNames())
        own = rows.filter("is_rejected").select(F.lit(name).alias("source"), "raw", "faults")
        rejected = own if rejected is None else rejected.unionByName(own)
    return Split(Sources(**good), rejected, {k: tuple(v) for k, v in commit.entry["counts"].items()})
