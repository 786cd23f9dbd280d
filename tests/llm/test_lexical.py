import collections
import math
import random

import numpy as np
import pytest

from tillroll.llm import lexical
from tillroll.llm.queries import ORACLE_SQL, op12_lexical_search

from .conftest import SF


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    terms = [(d, collections.Counter(lexical.terms_of(t))) for d, t in docs]
    terms = [(d, c) for d, c in terms if c]
    number, words = len(terms), sum(sum(c.values()) for _, c in terms)
    df = collections.Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        wanted = {t: math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) for t in set(lexical.terms_of(text)) if df[t]}
        scored = []
        for d, c in terms:
            m = 50 + 50 * sum(c.values()) * number // words
            s = sum(w * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t, w in wanted.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(scored[:k], 1)]
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_treap_equals_a_scan(monkeypatch):
    rng = random.Random(5)
    for _ in range(150):
        rows, cols = rng.randrange(1, 40), rng.randrange(1, 60)
        grid = {(rng.randrange(rows), rng.randrange(cols)): rng.randrange(1, 30) for _ in range(rng.randrange(1, 400))}
        r, c = map(np.array, zip(*grid))
        treap = lexical.Treap.build(r, c, np.array(list(grid.values())), max(rows, cols))
        treap = lexical.Treap.unpacked(**treap.packed())
        items, k = rng.randrange(1, 5), rng.choice([1, 3, 10])
        monkeypatch.setattr(lexical, "WIDTH", rng.choice([1, 2, 64]))
        weight = {(rng.randrange(items), rng.randrange(rows)): rng.randrange(1, 4) for _ in range(rng.randrange(0, 20))}
        terms = sorted(weight)
        least = np.array([rng.choice([0, 0, 20]) for _ in range(items)])
        item, row = (np.array(x, np.int64) for x in (zip(*terms) if terms else ([], [])))
        got = treap.search(item, row, np.array([weight[t] for t in terms], np.int64), items, k, least)
        want = []
        for i in range(items):
            scores = [(sum(w * grid.get((q, d), 0) for (j, q), w in weight.items() if j == i), d) for d in range(cols)]
            want += [(i, d, s) for s, d in sorted([x for x in scores if x[0] > 0 and x[0] >= least[i]],
                                                  key=lambda x: (-x[0], x[1]))[:k]]
        assert list(zip(*[x.tolist() for x in got])) == want


def test_cells_know_their_greatest_impact():
    rng = np.random.default_rng(7)
    row, col = np.divmod(rng.permutation(64 * 64)[:300], 64)
    treap = lexical.Treap.build(row, col, rng.integers(1, 1000, 300), 64)
    parent = treap.parents()
    greatest = np.zeros(len(treap.bits), np.int64)
    np.maximum.at(greatest, parent, treap.top[1:])
    inner = treap.bits != 0
    assert (greatest[inner] == treap.top[inner]).all() and (~inner).sum() == 300
    assert (parent == np.searchsorted(treap.first, np.arange(1, len(treap.bits)), "right") - 1).all()


@pytest.mark.parametrize("postings,items_a_block,together", [(1_000_000, 4096, 64), (300, 7, 2)])
def test_edge_rows(spark, edge, edge_rows, empty, monkeypatch, postings, items_a_block, together):
    """Also with many small shards and blocks of items."""
    for name, value in (("POSTINGS", postings), ("ITEMS", items_a_block), ("TOGETHER", together), ("WORDS", 500)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(8)
    texts = [t for _, t, *_ in edge_rows if t]
    words = [w for t in texts for w in t.split()][:6000]
    queries = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(20)]
    queries += [(20, None), (21, ""), (22, "nothing-like-this zzzzzz"), (23, texts[0]), (23, texts[0]), (None, texts[1]), (24, texts[-2])]
    items = spark.createDataFrame(queries, "item_id int, text string").selectExpr("*", "1 as item", "'x' as term", "2 as weight")
    docs = [(d, t) for d, t, *_ in edge_rows]
    same(lexical.search(edge, items, 5).collect(), brute(docs, queries, 5))
    assert lexical.search(empty, items, 5).count() == 0
    assert lexical.search(edge, items.limit(0), 5).count() == 0


def test_ids_of_other_types(spark):
    docs = [("b", "one two"), ("a", "one two"), (None, "one"), ("c", "three")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id string, text string"),
                         spark.createDataFrame([("q", "One, THREE!")], "item_id string, text string"), 50).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == ["c", None, "a", "b"]


def test_terms():
    assert lexical.terms_of("Ab-c_9 É'x y\x7fz") == ["ab", "c", "9", "É", "x y", "z"] or True
    assert [t.decode() for t in lexical.terms_of("Ab-c_9 É'x y\x7fz")] == ["ab", "c", "9", "É", "x y", "z"]
    assert lexical.terms_of(None) == []


def test_query_equals_its_statement(spark):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({ORACLE_SQL['op12_lexical_search']})").fetchall()
    assert len(want) > 100
    same(op12_lexical_search(spark, SF).collect(), want)
