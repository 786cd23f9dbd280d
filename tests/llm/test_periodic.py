import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import periodic
from tillroll.llm.queries import op11_periodic_runs

from .conftest import SF


def words_of(text):
    return (text or "").encode().split()


def brute_runs(w):
    """(start, length, period) by trying every period at every place."""
    found = {}
    number = {x: i for i, x in enumerate(w)}
    x = np.array([number[y] for y in w])
    for q in range(1, len(w) // 3 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[False], x[:-q] == x[q:], [False]]).astype(int)))
        for s, e in same.reshape(-1, 2):  # stretches of places that equal the one q later
            if e + q - s >= max(24, 3 * q):
                found.setdefault((int(s), int(e + q)), q)
    return sorted([(s, e - s, q) for (s, e), q in found.items()], key=lambda r: (r[0], r[2]))


def brute_row(w):
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def random_words(rng):
    """Noise, repeats of short and long units, repeats of repeats."""
    out = []
    for _ in range(rng.randrange(0, 5)):
        alphabet = [str(c).encode() for c in range(rng.choice([1, 2, 3, 50]))]
        unit = [rng.choice(alphabet) for _ in range(rng.randrange(1, rng.choice([3, 10, 40])))]
        kind = rng.randrange(3)
        if kind == 1:
            m = rng.randrange(len(unit), 4 * len(unit) + 1)
            unit = (unit * 5)[:m] + [rng.choice(alphabet)]
        if kind:
            m = rng.randrange(1, 6 * len(unit) + 30)
            out += (unit * (m // len(unit) + 1))[:m]
        else:
            out += [rng.choice(alphabet) for _ in range(rng.randrange(60))]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(250):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        assert periodic.find_runs(texts) == [brute_runs(w) for w in texts]


def test_fibonacci_words_and_single_letters():
    a, b = [b"a"], [b"b"]
    for _ in range(12):
        a, b = a + b, a
    assert periodic.find_runs([a, [b"a"] * 1000, [b"a"] * 23, [b"a"] * 24]) == [
        brute_runs(a), [(0, 1000, 1)], [], [(0, 24, 1)]]


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 64, 1000):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        low = rng.integers(0, n, 200)
        high = np.minimum(n, low + rng.integers(1, n + 1, 200))
        bound = rng.integers(0, 2 * n + 2, 200)
        assert tree.below(low, high, bound).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(low, high, bound)]
        k = rng.integers(0, 1 << 30, 200) % (high - low)
        assert tree.smallest(low, high, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(low, high, k)]


def test_query(spark):
    """The whole query on a small table, the planted periods included."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in op11_periodic_runs(spark, SF).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert len(got) == len(rows) and sum(v[0] for v in got.values()) > 0
    for r in rows:
        assert got[r["doc_id"]] == brute_row(planted(r["doc_id"], words_of(r["text"]))), r["doc_id"]


def test_edge_rows(spark, edge, edge_rows, empty):
    rows = {i: t for i, t, *_ in edge_rows}
    found = periodic.find(edge)
    got = periodic.summary(found).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        assert tuple(r)[1:] == brute_row(words_of(rows[r["doc_id"]])), r["doc_id"]
    real = found.filter("doc_id = 108").first()
    assert [tuple(r) for r in real["runs"]] == [(0, 140, 7)] and real["collapsed"] == "a line that comes again and again"
    changed = {r["doc_id"]: r["text"] for r in periodic.with_planted_periods(edge).collect()}
    assert all(words_of(changed[i]) == planted(i, words_of(t)) for i, t in rows.items())
    assert periodic.summary(periodic.find(periodic.with_planted_periods(empty))).count() == 0


def test_ties_go_to_the_earlier_run(spark):
    unit, other = [f"u{i}" for i in range(5)], [f"v{i}" for i in range(5)]
    text = " ".join(unit * 6 + ["x"] + other * 6 + ["y"] + [f"w{i}" for i in range(10)] * 6)
    r = periodic.summary(periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (3, 0, 30, 5, 6000)


def test_blocks_do_not_change_results(monkeypatch):
    rng = random.Random(6)
    texts = [b" ".join(random_words(rng)).decode() for _ in range(60)]
    whole = [r for w in periodic.blocks(texts) for r in periodic.find_runs(w)]
    monkeypatch.setattr(periodic, "WORDS", 100)
    assert [r for w in periodic.blocks(texts) for r in periodic.find_runs(w)] == whole


def test_a_long_text_with_one_run_over_all(spark):
    text = " ".join(f"w{i % 40_000}" for i in range(130_000))
    r = periodic.summary(periodic.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).withColumn("x", F.lit(1))).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (1, 0, 130_000, 40_000, 3250)
