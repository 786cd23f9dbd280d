"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped arrays.

Words are 64-bit hashes; a sorted hash array gives each its place, and pairs of places are the
keys of the sorted array of bigrams. Tasks count what they read, hand on packed sorted blocks per
shard, and one task per shard merges them and writes the shard's arrays to the shared folder.
Workers map the arrays to score texts. The model's order is 2: a third order would write about
twice as much again (README).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import arrays
from tillroll.llm.arrays import by_shard, pack, unpack
from tillroll.llm.common import remainder, scratch, stored
from tillroll.llm.hashing import blocks, mix, word_hashes

#: Tokens that a task counts before it hands on what it has.
HELD = 1_500_000
#: Words per shard of the word arrays, bigram entries before merging per shard of theirs.
WORDS_EACH, PAIRS_EACH = 1_000_000, 2_500_000
#: Tokens per shard of the word arrays at most.
TOKENS_EACH = 8_000_000
#: The end of a text, a token of its own.
END = mix(np.array([0x0E2D], np.uint64))[0]
_LOW = np.uint64(0xFFFFFFFF)
_PACKED = "kind int, shard int, keys binary, counts binary"


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 10) == 0


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their sums."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first)


def _token_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, int, np.ndarray, np.ndarray]]:
    """(batch, first row, tokens with an end after each text, where each text's tokens start)."""
    for batch in batches:
        for first, held in blocks(batch["text"]):
            words, bounds = word_hashes(held)
            tokens = np.insert(words, bounds[1:], END)
            yield batch, first, tokens, bounds + np.arange(len(bounds))


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[np.ndarray] = []

    def counted() -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        held.clear()
        return pd.DataFrame({"key": keys.view(np.int64), "n": n})

    for _, _, tokens, _ in _token_blocks(batches):
        held.append(tokens)
        if sum(map(len, held)) >= HELD:
            yield counted()
    yield counted()


@dataclass(frozen=True)
class Words:
    """The word arrays: ``key`` (hash), ``count``. A word's place counts on from shard to shard."""
    folder: str
    shards: int
    starts: tuple[int, ...]  # first place of each shard, then the number of words
    tokens: int

    @property
    def size(self) -> int:
        return self.starts[-1]

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, count) of each word."""
        distinct, back = np.unique(hashes, return_inverse=True)
        found, shard, place = arrays.find(self.folder, self.shards, distinct)
        count = np.zeros(len(distinct), np.int64)
        for s in np.unique(shard[found]):
            own = found & (shard == s)
            count[own] = arrays.mapped(self.folder, "count", int(s), np.int64)[place[own]]
        return np.where(found, np.array(self.starts)[shard] + place, -1)[back], count[back]

    def shard_at(self, places: np.ndarray) -> np.ndarray:
        """The shard of each place; the beginning of a text (place ``size``) has one of its own."""
        return np.searchsorted(np.array(self.starts[1:]), places, side="right")


@dataclass(frozen=True)
class Pairs:
    """The bigram arrays: ``key`` (place of the first word << 32 | place of the second), ``count``."""
    folder: str
    shards: int
    hot: tuple[int, ...]  # first words so common that their pairs are spread over all shards

    def shard_of(self, keys: np.ndarray, size: int) -> np.ndarray:
        first = keys >> np.uint64(32)
        out = (first * np.uint64(self.shards) // np.uint64(size + 1)).astype(np.int64)
        hot = np.isin(first, np.array(self.hot, np.uint64))
        out[hot] = (mix(keys[hot]) % np.uint64(self.shards)).astype(np.int64)
        return out


def _bigrams(words: Words, tokens: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, counts of the tokens, places of the tokens before them)."""
    place, count = words.places(tokens)
    before = np.concatenate([[0], place[:-1]])
    before[starts[:-1]] = words.size
    return place, count, before


def _count_pairs(words: Words, pairs: Pairs, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[np.ndarray] = []

    def counted() -> Iterator[pd.DataFrame]:
        if held:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from _packed(0, keys, {"n": n}, pairs.shard_of(keys, words.size))

    for _, _, tokens, starts in _token_blocks(batches):
        place, _, before = _bigrams(words, tokens, starts)
        held.append(before.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64))
        if sum(map(len, held)) >= HELD:
            yield from counted()
    yield from counted()


def _packed(kind: int, keys: np.ndarray, values: dict[str, np.ndarray], shard: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row per shard with its keys, which are in order, and its values, 32 bits each."""
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-2))
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        counts = np.stack([np.minimum(v[own], 2 ** 32 - 1).astype(np.uint32) for v in values.values()])
        yield pd.DataFrame({"kind": [kind], "shard": [int(shard[own[0]])], "keys": [pack(keys[own])],
                            "counts": [counts.view(np.uint8).reshape(-1, 4).T.tobytes()]})


def _unpacked(data: bytes, values: int) -> np.ndarray:
    flat = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return flat.reshape(values, -1).astype(np.int64)


def _merge_pairs(words: Words, pairs: Pairs, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Writes a shard's bigrams. Hands on, packed for the shards of the words: kind 1: distinct
    words before each word; kind 2: of each first word its tokens and how many bigrams it has once,
    twice, more often. Kind 3: how many bigrams occur 1, 2, 3, 4 times, and all."""
    for shard, rows in by_shard(batches):
        key, n = merged([unpack(r.keys) for r in rows], [_unpacked(r.counts, 1)[0] for r in rows])
        rows.clear()
        arrays.write(pairs.folder, "key", shard, key)
        arrays.write(pairs.folder, "count", shard, n.astype(np.uint32))
        first, second = key >> np.uint64(32), key & _LOW
        v, before = np.unique(second, return_counts=True)
        yield from _packed(1, v, {"n": before}, words.shard_at(v.astype(np.int64)))
        u, at = np.unique(first, return_index=True)
        sums = {"c": np.add.reduceat(n, at)} | {
            f"n{k}": np.add.reduceat((n == k if k < 3 else n >= 3).astype(np.int64), at) for k in (1, 2, 3)}
        yield from _packed(2, u, sums, words.shard_at(u.astype(np.int64)))
        yield pd.DataFrame({"kind": [3], "shard": [-1], "keys": [b""], "counts": [_tally(n)]})


def _tally(n: np.ndarray) -> bytes:
    return np.array([*[(n == r).sum() for r in (1, 2, 3, 4)], len(n), n.sum(), (n >= 3).sum()], np.int64).tobytes()


def _merge_words(words: Words, folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Writes of a shard of words ``before`` (distinct words before each), ``c`` and ``n1`` to ``n3``."""
    for shard, rows in by_shard(batches):
        base = words.starts[shard]
        size = words.starts[shard + 1] - base if shard < words.shards else 1
        before, sums = np.zeros(size, np.int64), np.zeros((4, size), np.int64)
        for r in rows:
            at = unpack(r.keys).astype(np.int64) - base
            if r.kind == 1:
                before[at] += _unpacked(r.counts, 1)[0]
            else:
                sums[:, at] += _unpacked(r.counts, 4)
        arrays.write(folder, "before", shard, before)
        for name, values in zip(("c", "n1", "n2", "n3"), sums):
            arrays.write(folder, name, shard, values)
        if shard < words.shards:
            yield pd.DataFrame({"kind": [3], "shard": [-1], "keys": [b""], "counts": [_tally(before)]})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; where too few counts of counts
    are known for the formula, 0.5, 0.75 and 1 take their place."""
    if min(n1, n2, n3, n4) <= 0:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return d if all(0 < x < r for x, r in zip(d, (1, 2, 3))) else (0.5, 0.75, 1.0)


@dataclass(frozen=True)
class Model:
    words: Words
    pairs: Pairs
    folder: str  # before, c, n1, n2, n3 per shard of words, and one for the beginning of a text
    high: tuple[float, float, float]
    low: tuple[float, float, float]
    kinds: int  # distinct bigrams
    spare: float  # share of the lower order that is spread evenly

    def _stats(self, place: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        distinct, back = np.unique(place, return_inverse=True)
        out = [np.zeros(len(distinct), np.int64) for _ in names]
        shard = self.words.shard_at(distinct)
        for s in np.unique(shard[distinct >= 0]):
            own = (shard == s) & (distinct >= 0)
            for o, name in zip(out, names):
                held = arrays.mapped(self.folder, name, int(s), np.int64)
                if len(held):
                    o[own] = held[distinct[own] - (self.words.starts[s] if s < self.words.shards else self.words.size)]
        return [o[back] for o in out]

    def probabilities(self, place: np.ndarray, before: np.ndarray) -> np.ndarray:
        """p(token | token before); place -1 is an unknown word."""
        even = 1.0 / (self.words.size + 1)
        (n,) = self._stats(place, ("before",))
        low = np.maximum(n - np.array([0.0, *self.low])[np.minimum(n, 3)], 0) / max(self.kinds, 1)
        low = low + self.spare * even
        c, n1, n2, n3 = self._stats(before, ("c", "n1", "n2", "n3"))
        key = before.astype(np.uint64) << np.uint64(32) | (place.astype(np.uint64) & _LOW)
        both = (place >= 0) & (c > 0)
        seen = np.zeros(len(place), np.int64)
        asked, back = np.unique(key[both], return_inverse=True)
        shard, count = self.pairs.shard_of(asked, self.words.size), np.zeros(len(asked), np.int64)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            held = arrays.mapped(self.pairs.folder, "key", int(s), np.uint64)
            if len(held):
                at = np.searchsorted(held, asked[own])
                at[at == len(held)] = 0
                hit = held[at] == asked[own]
                count[own[hit]] = arrays.mapped(self.pairs.folder, "count", int(s), np.uint32)[at[hit]]
        seen[both] = count[back]
        total = np.maximum(c, 1)
        left = (self.high[0] * n1 + self.high[1] * n2 + self.high[2] * n3) / total
        top = np.maximum(seen - np.array([0.0, *self.high])[np.minimum(seen, 3)], 0) / total
        return np.where(c > 0, top + left * low, low)


def train(texts: DataFrame) -> Model:
    """The model of all rows of ``texts`` (text). Nothing but sizes and counts of counts comes to
    the driver; the shards' number grows with the corpus, what a task holds does not."""
    spark = texts.sparkSession
    counted = texts.select("text").mapInPandas(_count_words, "key long, n long")
    table = stored(counted.groupBy("key").agg(F.sum("n").alias("count")), "lm-words")
    size, tokens = table.agg(F.count("*"), F.sum("count")).first()
    tokens = tokens or 0
    # what the shards of pairs hand to a shard of words grows with the tokens, so its number does
    shards = max(arrays.shards_for(size, WORDS_EACH), arrays.shards_for(tokens, TOKENS_EACH))
    folder = scratch(spark, "lm-word-arrays")
    rows = arrays.store_sorted(table, folder, shards, {"count": np.int64})
    words = Words(folder, shards, tuple(int(x) for x in np.concatenate([[0], np.cumsum(rows)])), tokens)

    n_pairs = arrays.shards_for(tokens, PAIRS_EACH)
    # words with so large a share of the tokens that their pairs weigh on a shard: fewer than 4 a shard
    common = table.where(F.col("count") * (4 * n_pairs) > tokens).select("key").collect()
    place, _ = words.places(np.array([r["key"] for r in common], np.int64).view(np.uint64))
    pairs = Pairs(scratch(spark, "lm-pair-arrays"), n_pairs, (*sorted(place.tolist()), words.size))
    blocked = texts.select("text").mapInPandas(partial(_count_pairs, words, pairs), _PACKED)
    handed = stored(blocked.repartition(n_pairs, "shard").sortWithinPartitions("shard").mapInPandas(
        partial(_merge_pairs, words, pairs), _PACKED), "lm-stats")
    folder = scratch(spark, "lm-stat-arrays")
    lower = handed.where("kind < 3").repartition(shards + 1, "shard").sortWithinPartitions("shard").mapInPandas(
        partial(_merge_words, words, folder), _PACKED).select("counts").collect()  # a row per shard

    def total(rows: list) -> np.ndarray:
        return sum((np.frombuffer(r["counts"], np.int64) for r in rows), np.zeros(7, np.int64))

    high = total(handed.where("kind = 3").select("counts").collect())  # a row per shard
    low = total(lower)
    d = discounts(*low[:4].tolist())
    kinds = int(low[5])
    spare = (d[0] * low[0] + d[1] * low[1] + d[2] * low[6]) / kinds if kinds else 1.0
    return Model(words, pairs, folder, discounts(*high[:4].tolist()), d, kinds, float(spare))


def _score(model: Model, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    w = model.words
    for batch, first, tokens, starts in _token_blocks(batches):
        place, count, before = _bigrams(w, tokens, starts)
        base = np.log10((count + 0.1) / (w.tokens + 0.1 * (w.size + 1)))
        score = np.log10(model.probabilities(place, before))
        at = starts[:-1]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].to_numpy()[first:first + len(at)], "n_tokens": np.diff(starts),
            "n_known": np.add.reduceat((count > 0).astype(np.int64), at), "train_tokens": w.tokens,
            "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(score, at)})


def score(docs: DataFrame, train_on: Column | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens,
    base_score, score, perplexity; scores are log10 probabilities of whole texts.

    The model learns from the rows for which ``train_on`` holds (default: all). Null texts count
    as empty: one token, the end. Repeated rows count and are scored each. Without training rows
    every token is unknown and both scores are 0. An empty table gives no rows; other columns are
    ignored."""
    taught = docs if train_on is None else docs.where(train_on)
    model = train(taught)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(partial(_score, model), (
        f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    ).withColumn("perplexity", F.exp(-F.col("score") * math.log(10) / F.col("n_tokens")))
