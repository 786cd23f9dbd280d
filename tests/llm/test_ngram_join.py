import random

import pytest

from tests.llm import brute
from tillroll.llm import ngram_join


def _corpus(seed):
    rng = random.Random(seed)
    vocabulary, texts = [f"w{i}" for i in range(300)], []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 30, 60]))]
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                p = rng.randrange(len(w))
                w[p:p + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(1, 2)
            if rng.random() < 0.3:
                w += "licensed under the common public terms version two".split()
            texts.append(" ".join(w).title() if rng.random() < 0.2 else "  ".join(w))
    rows = list(enumerate([*texts, "", None, "  ", "A b", "a B"]))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "common", "light"), [(5, 16, None), (6, 2, 0), (7, 2, 64), (8, 3, 6)])
def test_components_equal_brute_force(spark, monkeypatch, seed, common, light):
    monkeypatch.setattr(ngram_join, "COMMON", common)
    if light is not None:
        monkeypatch.setattr(ngram_join, "cost_boundary", lambda *_: light)
    rows = _corpus(seed)
    part = brute.components([i for i, _ in rows], brute.jaccard_links(rows))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == {
        (i, len(brute.shingles(texts[i])), part[i]) for i in texts}


def test_groups_whose_members_do_not_all_link(spark):
    """A chain: each links with the next only, all share rare shingles."""
    words = [f"u{i}" for i in range(120)]
    rows = [(i, " ".join(words[3 * i:3 * i + 40])) for i in range(20)]
    part = brute.components(range(20), brute.jaccard_links(rows))
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == part and len(set(part.values())) == 1


def test_edge_rows(edge, edge_rows, empty):
    got = ngram_join.join(edge).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[104]["component_id"] == 103 and by_id[None]["component_id"] == 103
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (100, 101, 102))
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.keep_one(edge)
    assert kept.columns == edge.columns and kept.where("doc_id = 104").count() == 0 and kept.where("doc_id = 103").count() == 1


def test_components_of_a_path(spark):
    from tillroll.llm.components import components
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(7, 7), (None, 3)], "a long, b long").repartition(6)
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(301)}
    assert components(edges.limit(0)).count() == 0


def test_keep_one_decides_by_row(spark):
    """Ids that occur twice with other texts, null ids, repeated rows and null or empty texts."""
    words = [f"w{i}" for i in range(200)]
    one, near, other, third = (" ".join(w) for w in (words[:40], [*words[:39], "x"], words[50:90], words[100:140]))
    rows = [(1, one, "a"), (1, one, "a"), (1, one, "b"), (2, near, "a"), (2, other, "a"), (None, one, "a"),
            (None, third, "a"), (None, third, "a"), (2, None, "a"), (3, "", "a"), (3, "", "a"), (4, near.upper(), "a")]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id int, text string, lang string").repartition(4)).collect()
    assert sorted([(r["doc_id"], r["text"]) for r in kept], key=str) == sorted(
        [(1, one), (2, other), (None, third), (2, None), (3, ""), (3, "")], key=str)


def test_a_large_group_just_below_the_threshold_gives_few_rows(spark):
    """Sets that share their rarest shingles and miss the threshold by one: no link, and the tasks that
    compare all of them hand on no pairs; with a second half that links, they hand on a tree."""
    import numpy as np

    base = np.arange(1, 76, dtype=np.uint64)
    n = 1500
    below = [np.concatenate([base[:60], np.arange(1000 + 100 * i, 1000 + 100 * i + 20, dtype=np.uint64)]) for i in range(n)]
    classes = np.arange(n, dtype=np.int64) + 1
    for sets, links in ((below, 0), ([base if i % 2 else np.sort(np.append(base, np.uint64(10**6 + i))) for i in range(n)], n - 1)):
        settler = ngram_join.Settler.__new__(ngram_join.Settler)
        settler.ids, settler.part, settler.groups = classes, np.arange(n), ngram_join.Groups(n)
        settler.links, settler.get = [], sets.__getitem__
        settler.long(np.arange(n))
        assert len(settler.links) == links
        settler.short([np.arange(16), np.arange(8, 20)])
        assert len(settler.links) == links


def test_long_lists_equal_brute_force(monkeypatch):
    import numpy as np

    monkeypatch.setattr(ngram_join, "BLOCK", 300)
    rng = random.Random(12)
    for _ in range(20):
        sets = []
        for _ in range(12):
            words = rng.sample(range(400), rng.randrange(4, 50))
            for _ in range(rng.randrange(1, 6)):
                sets.append(np.array(sorted({w if rng.random() > 0.08 else rng.randrange(400, 900) for w in words}), np.uint64))
        n = len(sets)
        settler = ngram_join.Settler.__new__(ngram_join.Settler)
        settler.ids, settler.part, settler.groups = np.arange(n), np.arange(n), ngram_join.Groups(n)
        settler.links, settler.get = [], sets.__getitem__
        settler.long(np.arange(n))
        want = brute.components(range(n), [(a, b) for a in range(n) for b in range(a) if ngram_join.linked(sets[a], sets[b])])
        assert brute.components(range(n), settler.links) == want and len(settler.links) == n - len(set(want.values()))
