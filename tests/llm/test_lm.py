import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tillroll.llm import lm


@pytest.mark.parametrize("sizes", [(2_000_000, 8_000_000), (9, 500)])
def test_scores_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(lm, "WORDS_EACH", sizes[0])
    monkeypatch.setattr(lm, "PAIRS_EACH", sizes[1])
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{int(80 * rng.random() ** 2)}" for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "Unseen W1  w2\nunseen")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    held = {r["doc_id"] for r in df.where(lm.held_out(F.col("doc_id"))).collect()}
    want, p, words = brute.kneser_ney([t for i, t in rows if i not in held], rows, lm.discounts)
    for prior in (b"<s>", b"w1", b"never"):  # the probabilities of all words and an unknown one
        assert math.isclose(sum(p(w, prior) for w in words) + p(b"never", prior), 1, rel_tol=1e-9)
    for r in lm.score(df, ~lm.held_out(F.col("doc_id"))).collect():
        n, known, tokens, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, tokens)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-9)


def test_packing_round_trip():
    import numpy as np
    keys = np.unique(np.random.default_rng(0).integers(0, 2 ** 63, 1000, dtype=np.uint64))
    assert (lm.unpack(lm.pack(keys)) == keys).all() and len(lm.unpack(lm.pack(keys[:0]))) == 0


def test_edge_rows(edge, edge_rows, empty):
    got = lm.score(edge).collect()
    assert len(got) == len(edge_rows) and all(r["score"] < 0 for r in got)
    assert lm.score(empty).count() == 0
    untaught = lm.score(edge, F.lit(False)).agg(F.max("n_known"), F.min("score"), F.min("base_score")).first()
    assert tuple(untaught) == (0, 0.0, 0.0)


def test_better_than_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = lm.held_out(F.col("doc_id"))
    base, score = lm.score(docs, ~held).where(held).agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base
