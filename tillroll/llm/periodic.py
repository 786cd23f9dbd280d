"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with least period q (words q apart are equal) that no neighbouring
word extends; runs of at least ``max(24, 3 * q)`` words are wanted. Texts of a block stand one
after the other as one array of word numbers in which no two texts share a number, so nothing
matches across texts.

* Names by doubling: level k gives equal names to equal blocks of 2**k words, in order of their
  words. The last level, where all names differ, is the suffix array.
* Every aligned block of 2**k words asks for its next occurrences in the neighbouring window:
  the suffix array's interval of its name, and there the next position, from a wavelet matrix.
* The occurrences in a window of the block's length are one progression. One or two are
  candidate periods themselves. Three or more mean that the block has a shorter period p; the
  distance of the candidates is then how far the stretch of period p is shifted, at its left
  or at its right end.
* A candidate (position, distance) is extended both ways by the names, and of equal stretches
  the least period stays.

A run of period q in [2**k, 2**(k+1)) has 3 * q words at least, so an aligned block of level k and
its copy q words later lie in it. Periods below 16 are asked for by blocks of 8 words, for which
24 words are enough.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of the texts that are looked at together; a longer text is a block of its own.
WORDS = 200_000
#: A run has this many words and this many periods at least; FIRST = log2 of LEAST / PERIODS.
LEAST, PERIODS, FIRST = 24, 3, 3


def blocks(texts: Iterable[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of some texts, about ``WORDS`` at a time; a null text has none."""
    held, size = [], 0
    for text in texts:
        words = text.encode("utf-8").split() if isinstance(text, str) else []  # splits at ASCII white space only
        if held and size + len(words) > WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys; equal keys have equal ranks."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), np.int32)
    out[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]), dtype=np.int32)
    return out


def _double(names: np.ndarray, width: int) -> np.ndarray:
    """Names of blocks twice as long. Behind the end lies what equals nothing."""
    after = np.full(len(names), -1, np.int64)
    after[:max(0, len(names) - width)] = names[width:]
    return _dense(names.astype(np.int64) * (len(names) + 1) + after + 1)


def name_levels(words: list[list[bytes]], levels: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words at every position, up to the level at which
    all differ."""
    levels = [first_names(words)] if levels is None else levels
    while len(levels[-1]) and levels[-1].max() + 1 < len(levels[-1]):
        levels.append(_double(levels[-1], 1 << (len(levels) - 1)))
    return levels


def first_names(words: list[list[bytes]]) -> np.ndarray:
    """Numbers of words that differ between texts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.empty(int(size.sum()), object)
    flat[:] = [w for text in words for w in text]
    code, distinct = pd.factorize(flat)
    return _dense(np.repeat(np.arange(len(words)), size) * (len(distinct) + 1) + code)


def repeating(words: list[list[bytes]]) -> np.ndarray:
    """Which texts hold some 8 words twice. Others have no run: its first 8 words come again
    ``q`` words later."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    names = first_names(words)
    for k in range(FIRST):
        names = _double(names, 1 << k) if len(names) else names
    text = np.repeat(np.arange(len(words)), size)
    out = np.zeros(len(words), bool)
    if len(names):
        out[text[np.bincount(names)[names] > 1]] = True
    return out


class Wavelet:
    """A wavelet matrix over numbers below 2**bits: per bit, how many ones lie before a place."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.ones: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            bit = values >> b & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values at places low..high-1 are less than ``bound``."""
        count = np.where(bound >> self.bits > 0, high - low, 0)
        low, high = low.copy(), np.where(bound >> self.bits > 0, low, high)
        for b, ones in zip(reversed(range(self.bits)), self.ones):
            l1, h1 = ones[low], ones[high]
            one = (bound >> b & 1) == 1
            zeros = len(ones) - 1 - ones[-1]
            count = count + np.where(one, high - low - (h1 - l1), 0)
            low, high = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, high - h1)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th least value (from 0) at places low..high-1, which are more than k."""
        out = np.zeros(len(low), np.int64)
        for ones, b in zip(self.ones, reversed(range(self.bits))):
            l1, h1 = ones[low], ones[high]
            zero = (high - low) - (h1 - l1)
            one = k >= zero
            zeros = len(ones) - 1 - ones[-1]
            out |= one.astype(np.int64) << b
            k = np.where(one, k - zero, k)
            low, high = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, high - h1)
        return out


class Text:
    """Words of a block of texts, ready for internal pattern matching."""

    def __init__(self, words: list[list[bytes]]) -> None:
        self.names = name_levels(words)
        self.n = len(self.names[0])
        if self.n:
            suffixes = np.empty(self.n, np.int64)
            suffixes[self.names[-1]] = np.arange(self.n)
            self.wavelet = Wavelet(suffixes)
            for k, names in enumerate(self.names):
                self.names[k] = np.append(names, np.int32(-1))

    def next(self, low: np.ndarray, high: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
        """The first ``most`` positions >= ``at`` in intervals of the suffix array, in order; n
        where there are no more."""
        before = self.wavelet.below(low, high, at)
        out = []
        for j in range(most):
            k = before + j
            some = np.flatnonzero(k < high - low)
            found = np.full(len(low), self.n, np.int64)
            found[some] = self.wavelet.smallest(low[some], high[some], k[some])
            out.append(found)
        return out

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal from a and b on (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            out += (names[np.minimum(a + out, self.n)] == names[np.minimum(b + out, self.n)]).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words are equal before a and b (a < b)."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names, x, y = self.names[k], a - out - (1 << k), b - out - (1 << k)
            same = (x >= 0) & (names[np.maximum(x, 0)] == names[np.maximum(y, 0)])
            out += same.astype(np.int64) << k
        return out

    def stretch(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest [start, end) around a in which words b - a apart are equal."""
        return a - self.backward(a, b), b + self.forward(a, b)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, later position): blocks and their next occurrences that may be a period
        apart."""
        for k in range(FIRST, len(self.names)):
            names, size = self.names[k][:-1], 1 << k
            count = np.bincount(names)
            ends = np.cumsum(count)
            at = np.arange(0, self.n, size)
            at = at[count[names[at]] > 1]
            if not len(at):
                return  # no block occurs twice, so no longer one does
            low, high = (ends - count)[names[at]], ends[names[at]]
            if k == FIRST:  # periods up to the block's length: the next occurrence is one off
                first, = self.next(low, high, at + 1, 1)
                near = first <= at + size
                yield at[near], first[near]
            one, two, three = self.next(low, high, at + size, 3)
            end = np.minimum(at + 2 * size, self.n)
            few = three >= end
            for found in (one, two):
                good = few & (found < end)
                yield at[good], found[good]
            many = np.flatnonzero(~few)
            if len(many):
                i, x, p = at[many], one[many], (two - one)[many]
                start, end = self.stretch(i, i + p)
                start_x, end_x = self.stretch(x, x + p)
                for shift in (start_x - start, end_x - end):
                    good = (shift > 0) & (i + shift < self.n)
                    yield i[good], (i + shift)[good]

    def runs(self) -> pd.DataFrame:
        """start, end, period of every run in the block, by start, then period."""
        found = [(*self.stretch(a, b), b - a) for a, b in self.candidates() if len(a)] if self.n else []
        out = pd.DataFrame({name: np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64)
                            for i, name in enumerate(("start", "end", "period"))})
        length = out["end"] - out["start"]
        out = out[(length >= LEAST) & (length >= PERIODS * out["period"])]
        # a stretch that has several periods here has the least one, which divides the others
        return out.groupby(["start", "end"], as_index=False)["period"].min().sort_values(["start", "period"])


def find_runs(words: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per text its runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    some = np.flatnonzero(repeating(words)) if words else []
    if len(some):
        size = np.array([len(words[i]) for i in some], np.int64)
        first = np.cumsum(size) - size
        runs = Text([words[i] for i in some]).runs()
        text = np.searchsorted(first, runs["start"].to_numpy(), "right") - 1
        for t, start, end, period in zip(text, runs["start"], runs["end"], runs["period"]):
            out[some[t]].append((int(start - first[t]), int(end - start), int(period)))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run behind its first period, joined by one space."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            depth[start + period] += 1
            depth[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(depth)) if not d]
    return b" ".join(words).decode("utf-8")


_RUNS = pa.list_(pa.struct({"start": pa.int64(), "length": pa.int64(), "period": pa.int64()}))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for words in blocks(batch.column("text").to_pylist()):
            runs = find_runs(words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").slice(at, len(words)), "n_words": np.array([len(w) for w in words], np.int64),
                "runs": pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUNS),
                "collapsed": pa.array([collapse(w, r) for w, r in zip(words, runs)], pa.string())})
            at += len(words)


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length, period by
    start, then period; word numbers from 0) and collapsed, the text without the repeated parts
    of its runs, words joined by one space.

    Nothing is shuffled: a document is looked at in one task, by itself. Null, empty and blank
    texts have no words and no runs; their collapsed text is empty. Repeated rows and null ids
    each keep their row; an empty table gives no rows; other columns are ignored. Memory grows
    with the longest text: about 4 bytes a word and doubling level where it repeats itself."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _find, f"doc_id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def summary(found: DataFrame) -> DataFrame:
    """The rows of ``find`` as numbers and digests: n_runs; start, length, period and exponent
    (in thousandths, rounded down) of the run with the greatest length / period, compared
    exactly (ties: least start, then period; nulls without a run); SHA-256 of all runs, a line
    each, and of the collapsed text."""
    def better(a: Column, b: Column) -> Column:  # runs come by start, then period
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.get("runs", F.lit(0)), better))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"),
                                                  F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the contract's change: with h = crc32 of the decimal id, n words and
    g = h div 10, where h % 10 = 0 the words from a = g % n on repeat the first p of them,
    p = 1 + (n - a) div (3 + g % 8). Changed texts are their words joined by one space; a null id
    counts as the empty text."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), g.alias("_g"))
    rows = rows.withColumn("_n", F.size("_words"))
    chosen = F.col("_n") > 0
    a = F.when(chosen, F.expr("_g % _n")).cast("int")
    rows = rows.withColumn("_a", a).withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    part = F.expr("slice(_words, _a + 1, _p)")
    copies = F.expr("cast((_n - _a + _p - 1) div _p as int)")
    tail = F.slice(F.flatten(F.array_repeat(part, copies)), F.lit(1), F.col("_n") - F.col("_a"))
    head = F.expr("slice(_words, 1, _a)")
    return rows.select("doc_id", F.when(chosen, F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))
