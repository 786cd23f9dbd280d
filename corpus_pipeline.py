"""Corpus pipeline: five stages over ``documents``, each written and read again by the next.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. Rows with null ids or texts, repeated rows and further columns
pass through as each operator's docstring says; empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import bpe, mixing, ngram_join, pii, toxicity
from tillroll.llm.common import ship, stored, table
from tillroll.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1, operator 8: documents that it finds toxic go. Labels teach it as in the query,
    without the held-out fifth. Rows that repeat an id are judged each by its own text."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2, operator 9: one row of each group stays, the one with the least id, a null
    one last. Rows that repeat an id are told apart by their text."""
    ship(spark)
    return ngram_join.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3, operator 4: every span found is replaced by its kind; n_chars follows the text."""
    ship(spark)
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
                            ) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4, operator 10: each document as often as the mix takes it."""
    ship(spark)
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5, operator 6: a row per emitted document: ids, their number, and digests."""
    ship(spark)
    return bpe.encode(docs, tokenizer_path(), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("pii", redact_pii),
    ("mixing", mix_sources), ("bpe", encode)]

#: Trained models and the tokenizer are beyond SQL; the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
