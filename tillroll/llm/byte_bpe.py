"""Byte-level BPE by padded matrices.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a block of texts
become rows of token numbers, a matrix for each class of lengths. In every round each row
merges its leftmost pair of least rank: one comparison over the whole matrix, one cell less
per row, two pairs looked up again. Rows without a known pair leave the matrix. Pairs lie in
one open hash table, so a lookup of many pairs is array arithmetic too.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tillroll.llm.arrays import KEPT, work_for

#: Pieces that are encoded together; cells of one matrix; pieces beyond this many bytes are rows
#: of their own, for which a round takes every merge that must come next.
PIECES, CELLS, LONG = 400_000, 1 << 20, 1024
#: The rank of no pair.
NONE = np.int32(np.iinfo(np.int32).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of ranks (base64 token, rank), in the order of their ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


class Pairs:
    """(left, right) -> rank: open addressing with linear probing, a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(4 * len(rank) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys = self._key(left, right)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):  # of those that want a free slot the last one gets it, the others go on
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = keys[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.ranks[slot] = rank

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; ``NONE`` where they don't merge. Numbers below 0 are no tokens."""
        shape = left.shape
        keys = np.where((left < 0) | (right < 0), np.int64(-2), self._key(left, right)).ravel()
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], NONE)
        todo = np.flatnonzero((held != keys) & (held != -1) & (keys >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        return out.reshape(shape)


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        # the library's engine takes white space as Unicode's property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        tokens = read_ranks(path)
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.byte < 0).any():
            raise ValueError(f"{path}: not every byte has a rank")
        known = self.ranks.get
        pairs = [(a, b, i) for i, t in enumerate(tokens) for k in range(1, len(t))
                 if (a := known(t[:k])) is not None and (b := known(t[k:])) is not None]
        self.pair = Pairs(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _matrix(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merges a matrix of tokens, -1 behind the end of a row. Yields (numbers of rows that
        are done, their tokens with -1 behind the end)."""
        at_row = np.arange(len(rows))
        rank = self.pair(rows[:, :-1], rows[:, 1:])
        while True:
            if rank.shape[1]:
                at = rank.argmin(1)
                best = rank[np.arange(len(rank)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                yield at_row[done], rows[done]
                if done.all():
                    return
                rows, rank, at_row, at, best = (x[~done] for x in (rows, rank, at_row, at, best))
            n, width = rows.shape
            each = np.arange(n)
            rows[each, at] = best
            keep = np.ones((n, width), bool)
            keep[each, at + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[each, at] = False
            rank = rank[keep].reshape(n, width - 2)
            right = np.flatnonzero(at < width - 2)
            rank[right, at[right]] = self.pair(rows[right, at[right]], rows[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pair(rows[left, at[left] - 1], rows[left, at[left]])

    def _row(self, row: np.ndarray) -> np.ndarray:
        """One long row. The least rank stays the least while its pairs are merged from the left,
        unless a merge makes a pair of a lower rank: up to there, all are merged in one round."""
        rank = self.pair(row[:-1], row[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, every other one from the left
            first = np.concatenate([[True], np.diff(at) > 1])
            group = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - group) % 2 == 0]
            new = np.full(len(at), least, row.dtype)
            before = np.where(at > 0, row[np.maximum(at - 1, 0)], -1)
            before[1:][np.diff(at) == 2] = least
            after = np.where(at + 2 < len(row), row[np.minimum(at + 2, len(row) - 1)], -1)
            lower = np.flatnonzero((self.pair(before, new) < least) | (self.pair(new, after) < least))
            if len(lower):
                at = at[:lower[0] + 1]
            row[at] = least
            row, rank = np.delete(row, at + 1), np.delete(rank, at)
            at = at - np.arange(len(at))
            for pos in (at[at > 0] - 1, at[at < len(rank)]):
                rank[pos] = self.pair(row[pos], row[pos + 1])
        return row

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of each piece's) of pieces that aren't empty. A piece that is a
        token is that token, as in the library."""
        n = np.ones(len(pieces), np.int64)
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int32)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        todo = np.flatnonzero(whole < 0)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        bucket = np.ceil(np.log2(np.maximum(length[todo], 2))).astype(np.int64)
        for b in np.unique(bucket):
            rows = todo[bucket == b]
            if (1 << b) > LONG:
                for r in rows:
                    ids = self._row(self.byte[np.frombuffer(pieces[r], np.uint8)])
                    n[r] = len(ids)
                    found.append((np.array([r]), ids))
                continue
            step = max(1, CELLS >> b)
            for some in (rows[i:i + step] for i in range(0, len(rows), step)):
                width = int(length[some].max())
                matrix = np.full((len(some), width), -1, np.int32)
                inside = np.arange(width) < length[some][:, None]
                matrix[inside] = self.byte[np.frombuffer(b"".join([pieces[r] for r in some]), np.uint8)]
                for k, ids in self._matrix(matrix):
                    real = ids >= 0
                    n[some[k]] = real.sum(1)
                    found.append((some[k], ids[real]))
        start = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.int32)
        for r, ids in found:
            out[places(start[r], n[r])] = ids
        return out, n

    def many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of texts; each distinct one is encoded once."""
        code, distinct = pd.factorize(np.array(pieces, object))
        ids, n = self.pieces([p.encode("utf-8") for p in distinct])
        return ids[places((np.cumsum(n) - n)[code], n[code])], n[code]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids."""
        return self.bytes[places(self.start[ids], self.size[ids])]

    def texts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of a text, ids, decoded bytes), in order and in parts: a text that is very
        long comes in several, and every text in one at least."""
        held: list[str] = []
        ends: list[tuple[int, int]] = []

        def flush() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            ids, n = self.many(held) if held else (np.empty(0, np.int32), np.empty(0, np.int64))
            to = np.concatenate([[0], np.cumsum(n)])
            data = self.decode(ids)
            byte = np.concatenate([[0], np.cumsum(self.size[ids])])
            a = 0
            for text, end in ends:
                i, j = to[a], to[end]
                yield text, ids[i:j], data[byte[i]:byte[j]]
                a = end
            held.clear()
            ends.clear()

        for k, text in enumerate(texts):
            if not isinstance(text, str):
                text = ""
            if len(text) <= PIECES:
                held += self.pattern.findall(text)
                ends.append((k, len(held)))
                if len(held) >= PIECES:
                    yield from flush()
                continue
            found = (m.group() for m in self.pattern.finditer(text))
            while True:
                before = len(held)
                held += islice(found, max(1, PIECES - before))
                ends.append((k, len(held)))
                if len(held) < PIECES:
                    break
                yield from flush()
        yield from flush()


_ENCODERS: dict[tuple[str, str], Encoder] = {}
KEPT["byte_bpe"] = _ENCODERS


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def _encode(path: str, pattern: str, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work_for("byte_bpe")
    e = encoder(path, pattern)
    for batch in batches:
        texts, n = batch.column("text").to_pylist(), np.zeros(len(batch), np.int64)
        if digests:
            of_ids, of_text = [[hashlib.sha256() for _ in texts] for _ in range(2)]
            for k, ids, data in e.texts(texts):
                n[k] += len(ids)
                of_ids[k].update(ids.astype("<u4").tobytes())
                of_text[k].update(data.tobytes())
            real = {"ids_sha256": [h.hexdigest() for h in of_ids], "decoded_sha256": [h.hexdigest() for h in of_text]}
        else:
            parts: list[list] = [[] for _ in texts]
            for k, ids, data in e.texts(texts):
                n[k] += len(ids)
                parts[k].append((ids, data.tobytes()))
            real = {"ids": pa.array([np.concatenate([i for i, _ in p]) for p in parts], pa.list_(pa.int32())),
                    "decoded": [b"".join([d for _, d in p]).decode("utf-8") for p in parts]}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": n, **real})


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids, decoded; with
    ``digests`` the SHA-256 of the ids (little-endian, 32 bits each) and of the decoded bytes
    instead of both. Results equal the tiktoken library's for ``encode_ordinary``.

    ``path`` is the file of ranks, there on every executor; ``pattern`` cuts texts into pieces.
    Nothing is shuffled, and a text's pieces are encoded in parts of bounded number. Null texts
    count as empty: no tokens, empty decoded text. Repeated rows and null ids each keep their
    row; an empty table gives no rows; other columns are ignored."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    real = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInArrow(
        partial(_encode, path, pattern, digests), f"doc_id {id_type}, n_tokens long, {real}")
