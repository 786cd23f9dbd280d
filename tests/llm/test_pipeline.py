import sys

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import SF

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the last result."""
    import corpus_pipeline
    from tillroll.llm.common import stored
    seen = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), "test-stage"))
    return seen


def test_decisions_take_effect(spark, stages):
    from tillroll.llm import mixing, pii, toxicity
    docs, clean, single, redacted, mixed, encoded = stages
    assert all(s.columns == docs.columns for s in stages[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = toxicity.detect(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    assert {r[0] for r in clean.select("doc_id").collect()} == {r[0] for r in verdict.where(~toxicity.is_toxic()).select("doc_id").collect()}
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    part = brute.components([i for i, _ in rows], brute.jaccard_links(rows))
    assert {r[0] for r in single.select("doc_id").collect()} == {i for i in part if part[i] == i}
    assert all(not brute.base_spans(r["text"]) for r in redacted.collect()) and redacted.count() == single.count()
    assert pii.report(single).where("spans != ''").count() == redacted.join(
        single.select("doc_id", F.col("text").alias("before")), "doc_id").where("text != before").count()
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(redacted).collect()}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: c for i, c in plan.items() if c}
    assert encoded.count() == mixed.count()


def test_run_and_edges(spark, edge, empty, labels, tmp_path):
    import corpus_pipeline
    for i, df in enumerate((edge, empty)):
        folder = f"{tmp_path}/{i}"
        df.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder)
        assert (got.count() > 0) == (i == 0) and "ids_sha256" in got.columns


def test_registered(spark):
    import __spark_entry__ as entry
    found = entry.queries()
    assert "pipeline" in found and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in found}
    assert {k for k in entry.oracle_sql() if k.startswith("op")} == {"op2_near_embeddings", "op7_url_filters", "op9_ngram_join", "op10_mixing", "op12_lexical_search"}
