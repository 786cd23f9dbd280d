import cProfile
import pstats
import random
import re

import numpy as np
import pandas as pd

from tests.llm import brute
from tillroll.llm import arrays, paragraphs
from tillroll.llm.hashing import word_places


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def test_bands():
    bands, rows = paragraphs.tune_bands()
    assert paragraphs.expected_recall(bands, rows, 0.75) >= 0.95
    assert paragraphs.expected_recall(bands, rows, 0.05) <= 0.02


def test_planted_passages_are_found_and_no_others(spark):
    rng = random.Random(4)
    docs, planted = [_words(rng, rng.randrange(60, 300)) for _ in range(150)], {}
    for _ in range(8):
        passage = _words(rng, rng.randrange(51, 70))
        for d in rng.sample(range(150), rng.randrange(2, 6)):
            at = rng.randrange(len(docs[d]))
            docs[d][at:at] = passage
            planted.setdefault(d, []).append(" ".join(passage))
    one = _words(rng, 200)
    docs += [one, [*one[:100], "changed", *one[101:]], _words(rng, 40) * 6]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    got = paragraphs.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # the last document repeats itself only
    assert {r["doc_id"] for r in got} == set(planted) | {150, 151}
    for r in got:
        text = rows[r["doc_id"]][1][r["start"]:r["end"]]
        assert r["kept"] == (r["keeper"] == r["doc_id"]) and len(text.split()) == r["n_words"]
    least = {r["component_id"]: r["keeper"] for r in got}
    assert all(r["doc_id"] >= least[r["component_id"]] for r in got)


def test_edge_rows(edge, empty):
    got = paragraphs.find(edge).collect()
    assert {r["doc_id"] for r in got} >= {103, 104, None}
    assert {r["kept"] for r in got if r["doc_id"] == 103} == {True}
    assert {r["kept"] for r in got if r["doc_id"] in (104, None)} == {False}
    assert not {100, 101, 102} & {r["doc_id"] for r in got}
    assert paragraphs.find(empty).count() == 0


def _covered(got, texts):
    """{(doc_id, kept): the words of each row, by index}."""
    out = {}
    for r in got:
        first = len(texts[r["doc_id"]][:r["start"]].split())
        out.setdefault((r["doc_id"], r["kept"]), []).append(set(range(first, first + r["n_words"])))
    return out


def test_passages_are_covered_from_end_to_end(spark):
    rng = random.Random(8)
    docs, planted = [_words(rng, rng.randrange(60, 200)) for _ in range(60)], []
    for p in range(20):
        passage = _words(rng, rng.randrange(51, 160))
        for d in (p, p + 20, p + 40):
            at = rng.randrange(len(docs[d]))
            docs[d][at:at] = passage
            planted.append((d, at, len(passage)))
    texts = {i: " ".join(w) for i, w in enumerate(docs)}
    got = paragraphs.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    for d, at, n in planted:
        # a span that is nearly common may reach a few words beyond
        assert any(set(range(at, at + n)) <= own <= set(range(at - 4, at + n + 4))
                   for own in _covered(got, texts).get((d, d < 20), []))


def test_edited_paragraphs_link_as_in_brute_force(spark):
    """Lines in longer documents, and copies with one or more words changed."""
    rng = random.Random(9)
    lines, docs = [], [[] for _ in range(80)]
    for p in range(120):
        base = _words(rng, rng.choice([12, 25, 40, 60, 90]))
        other = list(base)
        for w in rng.sample(range(len(other)), rng.choice([0, 1, 1, 2])):
            other[w] = f"edit{p}"
        if p == 0:  # both ends far from the edit, and no span of 20 words in common
            base = _words(rng, 40)
            other = [*base[:21], "edited", *base[22:]]
        one, two = rng.sample(range(80), 2)
        for d, words in ((one, base), (two, other)):
            docs[d].append(" ".join(words))
            lines.append((d, len(docs[d]) - 1))
    texts = {i: "\n".join(x) for i, x in enumerate(docs)}
    got = _covered(paragraphs.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect(), texts)
    links = brute.jaccard_links([(n, docs[d][k]) for n, (d, k) in enumerate(lines)])
    assert len(links) > 70 and (0, 1) in links
    found = 0
    for pair in links:
        whole = []
        for n in pair:
            d, k = lines[n]
            first = len(" ".join(docs[d][:k]).split())
            own = set(range(first, first + len(docs[d][k].split())))
            whole.append(any(own <= x for kept in (True, False) for x in got.get((d, kept), [])))
        found += all(whole)
    print(f"{found} of {len(links)} links found")
    assert found >= 0.95 * len(links)


def test_links_beside_a_list_s_least_unit_are_not_lost(spark, monkeypatch):
    """All units are in one list, so those in the document of its least one are paired within it."""
    monkeypatch.setattr(paragraphs, "tune_bands", lambda *_: (1, 0))
    rng, texts = random.Random(10), {}
    for i in range(6):
        lines = [_words(rng, 25) for _ in range(4)]
        texts[i] = "\n".join(" ".join(x) for x in lines)
        texts[i + 6] = "\n".join(" ".join([*x[:24], f"edit{i}"]) for x in lines)
    got = _covered(paragraphs.find(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect(), texts)
    for d in texts:
        assert set().union(*got.get((d, d < 6), [])) == set(range(100))


def _odd_texts(rng, n):
    parts = ["a ", "b ", "\n", "cc ", "\n\n", "\t", "\u00e9x ", "\u6f22 "]
    return [None, "", " ", "\n \n", "a b c d", "a b c d e", *(
        "".join(rng.choice([*parts, f"{rng.random()} "]) for _ in range(rng.randrange(300))) for _ in range(n))]


def test_units_are_cut_and_hashed_a_block_at_a_time():
    """Reading a text took about 150 calls of its own, in each of five or six readings."""
    texts = _odd_texts(random.Random(11), 1000)
    profile = cProfile.Profile()
    together = profile.runcall(lambda: list(paragraphs._units(pd.DataFrame({"text": texts}))))
    assert pstats.Stats(profile).total_calls < 30 * len(texts)
    alone = [(i, u, s) for i, t in enumerate(texts) for u, s in paragraphs._units(pd.DataFrame({"text": [t]}))]
    for name in ("start", "size", "digest", "salt"):
        assert np.array_equal(np.concatenate([getattr(u, name) for u, _ in together]),
                              np.concatenate([getattr(u, name) for _, u, _ in alone]))
    shingles = {r: x for _, held in together for r, x in held.items()}
    assert shingles.keys() == {i for i, *_ in alone}
    assert all(np.array_equal(shingles[i], s[0]) for i, _, s in alone)


def test_spans_start_at_the_leftmost_least_of_each_window():
    rng = np.random.default_rng(12)
    sizes = [0, 4, 5, 19, 20, 29, 30, 31, 200, 0, 47]
    words = rng.integers(0, 6, sum(sizes)).astype(np.uint64)  # few, so that trigrams come again
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    want = []
    for i, n in enumerate(sizes):
        own = words[bounds[i]:bounds[i + 1]]
        tri = paragraphs.combine(paragraphs.combine(own[:-2], own[1:-1]), own[2:]) if n >= 3 else []
        at = {s + int(np.argmin(tri[s:s + paragraphs.GAP])) for s in range(max(0, len(tri) - paragraphs.GAP) + 1)} if n >= paragraphs.SPAN else set()
        at = {a for a in at if a <= n - paragraphs.SPAN}
        want += [(i, a) for a in sorted(at) or [0] * (n >= paragraphs.LEAST_WORDS)]
    text, start = paragraphs.anchors(words, bounds)
    assert list(zip(text.tolist(), start.tolist())) == want


def test_word_places_are_code_points():
    for text in filter(None, _odd_texts(random.Random(13), 50)):
        start, end = word_places(text)
        assert list(zip(start.tolist(), end.tolist())) == [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def _store(folder, keys, **values):
    order = np.argsort(keys)
    arrays.write(str(folder), "key", 0, keys[order])
    for name, held in values.items():
        arrays.write(str(folder), name, 0, held[order])
    return str(folder), 1


def test_documents_that_keep_nothing_are_not_cut_again(tmp_path, monkeypatch):
    """All texts were cut into units in each of five or six readings; three of these are about few documents."""
    rng = random.Random(14)
    passage = _words(rng, 60)
    texts = [" ".join([*_words(rng, 50), *(passage if d in (3, 7) else []), *_words(rng, 50)]) for d in range(20)]
    units = [u for u, _ in paragraphs._units(pd.DataFrame({"text": texts}))]
    digest, row = (np.concatenate([getattr(u, name) for u in units]) for name in ("digest", "row"))
    common, where = np.unique(digest[row == 3][np.isin(digest[row == 3], digest[row == 7])]), np.int64(3)
    assert len(common)
    keeper = np.full(len(common), where)
    marked = _store(tmp_path / "marked", common.view(np.uint64), row=keeper, keeper=keeper, component=common)
    docs = _store(tmp_path / "docs", paragraphs.doc_key(np.array([3])))
    cut, whole = [], paragraphs._units
    monkeypatch.setattr(paragraphs, "_units", lambda batch: cut.extend(batch["text"]) or whole(batch))
    batch = pd.DataFrame({"row": np.arange(20), "text": texts})
    sets = pd.concat(paragraphs._emit_sets(marked, docs, iter([batch])))
    assert set(sets["class"]) == set(common.tolist())
    near = pd.concat(paragraphs._emit_near(marked, docs, iter([batch])))
    assert near["class"].tolist() == paragraphs.doc_key(np.array([3])).view(np.int64).tolist()
    shared = _store(tmp_path / "shared", np.empty(0, np.uint64), n=np.empty(0, np.int64), last=np.empty(0, np.int64))
    kept = pd.concat(paragraphs._keep(marked, docs, shared, iter([batch])))
    assert set(kept["row"]) == {3} and kept["kept"].all()
    assert cut == [texts[3]] * 3


def test_digests_are_of_shingles_at_their_places():
    rng = np.random.default_rng(15)
    runs = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    count = np.array([1, 16, 16, 15, 17, 300, 16, 40])
    begin = np.array([299, 284, 0, 5, 5, 0, 100, 260])
    want = [paragraphs.mix(np.array([paragraphs.mix(runs[b:b + n] ^ paragraphs.mix(np.arange(n, dtype=np.uint64))).sum() + np.uint64(n)]))[0]
            for b, n in zip(begin, count)]
    assert paragraphs._digests(runs, begin, count).tolist() == want
