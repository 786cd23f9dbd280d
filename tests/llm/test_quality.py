import math

import numpy as np

from tests.llm import brute
from tillroll.llm import quality


def test_base_equals_brute_force(spark, edge, edge_rows, labels):
    found = quality.judge(edge, labels).collect()
    assert len(found) == len(edge_rows)
    want = {(i, *brute.quality_base(t)) for i, t, *_ in edge_rows}
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {tuple(r[n] for n in names) for r in found} == want
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_words_end_at_ascii_space_only():
    assert quality.features("a\x1cb c\u00a0d e\u2003f\tg")[0] == 4


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, 0.1), (50, 3, 0.02), (200, 10, 0.05), (7, 7, 0.3)):
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(math.exp(quality.log_tail(n, k, p)), want, rel_tol=1e-9)


def test_cutoff_limits_false_rejection():
    rng = np.random.default_rng(0)
    wrong = 0
    for _ in range(200):
        held = np.bincount(rng.binomial(100, 0.2, 3000), minlength=101)
        c = quality.choose(held, 3000, 0.01, 0.05)
        beyond = 1.0 - sum(math.comb(100, i) * 0.2 ** i * 0.8 ** (100 - i) for i in range(c))
        wrong += beyond > 0.01
    assert wrong <= 20  # 5 % expected at most
    assert quality.choose(np.array([5, 0, 0]), 5, 0.01, 0.05) is None  # too few rows for any test


def test_no_labels_and_no_rows(edge, empty, labels, no_labels):
    assert quality.judge(empty, labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.judge(edge, no_labels).collect())


def test_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where(
        "quality = 1 and not base_failed").select("kept").collect()
    assert sum(r["kept"] for r in found) >= 0.97 * len(found)
