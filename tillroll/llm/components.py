"""Connected components of a graph given as edges, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

#: Edges that one step of the contraction holds at most.
BLOCK = 500_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Within a partition, blocks of edges shrink to stars: at most one edge per vertex."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def flush() -> pd.DataFrame:
        pairs = [(x, r) for x in root if (r := find(x)) != x]
        root.clear()
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    seen = 0
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        seen += len(batch)
        if seen >= BLOCK:
            yield flush()
            seen = 0
    yield flush()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (id, component): the least id reachable, for every id of an edge.

    Edges are first contracted within partitions. Then large-star and small-star steps (Kiveris
    et al., 2014) alternate until nothing changes: each vertex hands its larger, then its smaller
    neighbours to its least one. Every step is a min per vertex (partial sums before the shuffle)
    and a join with that table, which holds a vertex once, so a vertex with very many edges can be
    split. Each round is written to the shared folder: plans stay short and lost executors cost
    one round. Direction and repeats of edges and edges from an id to itself don't matter; edges
    with nulls are ignored; no edges give no rows."""
    plain = edges.where("a is not null and b is not null and a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stored(plain.mapInPandas(_contract, "a long, b long").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a and b != m").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = stored(small.where("a != b").distinct(), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
