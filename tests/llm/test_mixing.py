import random

import duckdb
import pytest

from tillroll.llm import mixing
from tillroll.llm.queries import OP10_SQL


def _targets(sizes):
    """Shares by weight, again and again, until no target is above twice its source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_equal_brute_force(spark):
    rng = random.Random(1)
    for n in (1, 2, 3, 7, 20):
        sizes = {(f"s{i}" if i else None): rng.choice([0, 5, rng.randrange(1, 10 ** rng.randrange(1, 7))]) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)


def test_plan_equals_sql(spark, edge):
    got = mixing.mix_plan(edge).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.register("documents", edge.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    want = con.sql(OP10_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_salted_join_gives_the_same(spark, edge, monkeypatch):
    plain = sorted(map(tuple, mixing.mix_plan(edge).collect()), key=repr)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, mixing.mix_plan(edge).collect()), key=repr) == plain


def test_rows_are_emitted_as_planned(spark, edge, empty):
    plan = mixing.mix_plan(edge).collect()
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert all(r["taken"] <= 2 * r["size"] for r in plan)
    assert mixing.mix(empty).count() == 0 and mixing.mix_plan(empty).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_taken_is_near_the_target(spark, sf):
    """Within 2 % for every source."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = mixing.mix_plan(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 0.02 * r["max(target)"] for r in rows)


def test_every_document_has_the_same_chance(spark):
    """Over all seeds a document gets its further copy as often as the fraction says."""
    from pyspark.sql import functions as F
    docs = spark.range(200).selectExpr("id as doc_id").withColumn("fraction", F.lit(0.3125))
    part, early = mixing._place(F.col("doc_id"), F.col("fraction"), "x")
    every = docs.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(mixing.SEEDS - 1).cast("long"))))
    n = every.where(mixing._covered(part, early, F.col("start"), F.col("fraction"))).groupBy("doc_id").count().collect()
    assert len(n) == 200 and {r["count"] for r in n} == {80}  # 256 * 0.3125
