"""Helpers shared by the training-data operators."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.arrays import tidy, write_file
from tillroll.session import scratch_root

#: A word, for Java's and RE2's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch, where the session has Spark's own 64 MB.
BATCH = 8 << 20
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that its functions can run
    there wherever the driver was started from. The archive stays in the shared folder. Texts
    are handed to Python in batches of ``BATCH`` bytes unless the session asks for less."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB") == str(64 << 20):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package, held = Path(__file__).resolve().parents[1], io.BytesIO()
        with zipfile.ZipFile(held, "w") as out:
            for f in sorted(package.rglob("*.py")):
                out.write(f, f.relative_to(package.parent))
        folder = scratch(spark, "code")
        context.addPyFile(write_file(folder, f"{package.name}.zip", held.getvalue()))
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where it is unset and tasks run in the
    driver's process (tests), an error elsewhere."""
    return (spark.conf.get("spark.checkpoint.dir", "") or scratch_root(spark)).rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/llm/{what}-{uuid.uuid4().hex}"


#: For rows that hold large blocks: the writer looks at its buffers after every few rows.
BLOCKS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "2",
          "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "8",
          "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false"}


def stored(df: DataFrame, what: str, blocks: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: work is done once, a
    lost executor costs no recomputation, and later plans start from files. What was shuffled
    for it goes at once."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with tidy(spark):
        df.write.options(**BLOCKS if blocks else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(modulus)


def null_safe_key(name: str) -> Column:
    return F.struct(F.col(name).isNull().alias("n"), F.col(name).alias("v"))


def small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows (reads no more than it must)."""
    return df.limit(rows + 1).count() <= rows


#: Characters at which ``str.split`` cuts and words do not end.
_ODD_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r") + "]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """The words of ``text``; ``str.split`` where it cuts at the same characters."""
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def lower_words(text: str) -> list[bytes]:
    """Words as UTF-8 with A-Z lowered: ``bytes`` methods know ASCII only, which is the rule.
    Lone surrogates cannot occur in Spark strings."""
    return text.encode("utf-8").lower().split()


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame | None],
                schema: T.StructType | str) -> DataFrame:
    """``mapInPandas`` for a function of one batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out
    return df.mapInPandas(run, schema)
