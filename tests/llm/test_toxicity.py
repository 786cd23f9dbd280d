import random

from pyspark.sql import functions as F

from tillroll.llm import toxicity


def _brute(scores):
    """All maximal segments by their definition, recursively: the best one, then both sides."""
    def best(lo, hi):
        top = None
        for s in range(lo, hi):
            total = 0.0
            for e in range(s, hi):
                total += scores[e]
                if total > 1e-12 and (top is None or total > top[2] + 1e-12):
                    top = (s, e + 1, total)
        if top is None:
            return []
        return best(lo, top[0]) + [top] + best(top[1], hi)
    return best(0, len(scores))


def test_segments_equal_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        scores = [rng.uniform(0.1, 3) if rng.random() < 0.3 else -0.7 for _ in range(rng.randrange(1, 40))]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s > 0], 0.7)
        want = _brute(scores)
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
        assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(got, want))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.held_out(F.col("doc_id"))
    got = toxicity.detect(spark.read.parquet(f"{sf}/documents.parquet"), labels, ~held).where(held).join(
        labels, "doc_id").groupBy("toxic").agg(F.avg(toxicity.is_toxic().cast("int")), F.count("*")).collect()
    rate = {r["toxic"]: r[1] for r in got}
    assert rate[1] >= 0.85 and rate[0] <= 0.01


def test_held_out_labels_teach_nothing(spark, edge, labels):
    held = toxicity.held_out(F.col("doc_id"))
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.detect(edge, x, ~held).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)


def test_edge_rows(edge, edge_rows, empty, labels, no_labels):
    got = toxicity.detect(edge, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.detect(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.detect(edge, no_labels).select("score").collect()} == {0.5}
    kept = toxicity.clean(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r["score"] < 0.5 for r in got)
