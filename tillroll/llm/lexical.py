"""Ranked lexical search with K2-treaps.

Documents are dealt into shards as they are read. A shard is a grid of its terms (rows, by falling
number of documents) and its documents (columns, by id), cut into quarters again and again. A
cell that holds one posting is a leaf with its row and column; any other one holds which of its
quarters are filled and the greatest impact in it, as the difference from its parent's. Cells
are numbered level by level, so the children of a cell follow from a count of the bits before.

A search starts at the root with the rows of an item's terms. For a range of documents each term
stands in the cell that holds its row; the sum of weight x impact over those cells bounds every
score in the range. The ranges of greatest bounds are halved first, all terms in step, for all
items of a block at a time; what cannot reach an item's best documents so far is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.byte_bpe import places
from tillroll.llm.common import stored

#: Postings after which a shard is closed; words that are looked at together.
POSTINGS, WORDS = 1_000_000, 200_000
#: Items of a block, which the driver hands to all tasks; items that a task searches for at a
#: time; ranges halved per item and round.
ITEMS, TOGETHER, WIDTH = 4096, 32, 128

_TERM = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()  # lowers A-Z only
_POP = np.array([bin(b).count("1") for b in range(16)], np.int8)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered."""
    return text.encode("utf-8").translate(_TERM).split() if isinstance(text, str) else []


def _bits(n: int) -> int:
    return max(1, (max(n, 1) - 1).bit_length())


def _spread(x: np.ndarray) -> np.ndarray:
    """Bit i of numbers below 2**31 moves to bit 2 i."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x.astype(np.int64)


class Treap:
    """The grid of one shard. ``bits``: which quarters of a cell are filled, none of a leaf's;
    ``top``: greatest impact; ``row`` and ``col`` of the leaves, in order."""

    def __init__(self, height: int, bits: np.ndarray, top: np.ndarray, row: np.ndarray, col: np.ndarray) -> None:
        self.height, self.bits, self.top, self.row, self.col = height, bits, top, row, col
        self.first = np.concatenate([[1], 1 + np.cumsum(_POP[bits], dtype=np.int64)])[:len(bits)]
        self.leaf = np.cumsum(bits == 0) - 1

    @classmethod
    def build(cls, row: np.ndarray, col: np.ndarray, impact: np.ndarray, side: int) -> "Treap":
        """From postings, each (row, col) once and both below ``side``; one at least."""
        height = _bits(side)
        code = _spread(row) << 1 | _spread(col)
        order = np.argsort(code)
        code, row, col, impact = (x[order] for x in (code, row.astype(np.int32), col.astype(np.int32), impact.astype(np.int64)))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for level in range(height + 1):
            if not len(code):
                break
            shift = 2 * (height - level)
            cell = code >> shift
            start = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            size = np.diff(np.append(start, len(cell)))
            filled = 1 << (code >> max(shift - 2, 0) & 3)
            alone = size == 1
            out[0].append(np.where(alone, 0, np.bitwise_or.reduceat(filled, start)).astype(np.uint8))
            out[1].append(np.maximum.reduceat(impact, start))
            out[2].append(row[start[alone]])
            out[3].append(col[start[alone]])
            rest = np.repeat(~alone, size)
            code, row, col, impact = code[rest], row[rest], col[rest], impact[rest]
        return cls(height, *(np.concatenate(x) for x in out))

    def parents(self) -> np.ndarray:
        """The parent of every cell but the root."""
        return np.repeat(np.arange(len(self.bits)), _POP[self.bits])

    def packed(self) -> dict[str, bytes | int]:
        """Impacts as differences from the parent's; ranges of cells as plain bytes."""
        lower = self.top.copy()
        lower[1:] = self.top[self.parents()] - self.top[1:]
        return {"height": self.height, "bits": self.bits.tobytes(), "lower": lower.astype(np.int32).tobytes(),
                "row": self.row.tobytes(), "col": self.col.tobytes()}

    @classmethod
    def unpacked(cls, height: int, bits: bytes, lower: bytes, row: bytes, col: bytes) -> "Treap":
        own = np.frombuffer(bits, np.uint8)
        top = np.frombuffer(lower, np.int32).astype(np.int64)
        out = cls(height, own, top, np.frombuffer(row, np.int32), np.frombuffer(col, np.int32))
        a, b = 0, 1  # the cells of a level
        while a < b:
            filled = _POP[own[a:b]].astype(np.int64)
            c = b + int(filled.sum())
            top[b:c] = np.repeat(top[a:b], filled) - top[b:c]
            a, b = b, c
        return out

    def search(self, item: np.ndarray, row: np.ndarray, weight: np.ndarray, items: int, k: int,
               least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, column, score) of the ``k`` best columns of each item, ties by column, by item;
        scores are above 0 and at least ``least`` of the item. Terms come as (item, row,
        weight above 0), by item."""
        # the frontier: ranges of 2**size columns, each with a cell per term that is left
        here = np.flatnonzero((self.bits[0] != 0) | (self.row[0] == row))
        term, cell = here, np.zeros(len(here), np.int64)
        start = np.flatnonzero(np.concatenate([[True], np.diff(item[term]) != 0])) if len(term) else np.empty(0, np.int64)
        front = {"item": item[term[start]], "col": np.zeros(len(start), np.int64), "size": np.full(len(start), self.height),
                 "off": start, "len": np.diff(np.append(start, len(term))),
                 "bound": np.add.reduceat(weight[term] * self.top[cell], start) if len(term) else np.empty(0, np.int64)}
        pool_term, pool_cell, used = term.astype(np.int32), cell, len(term)
        best = {"item": np.empty(0, np.int64), "col": np.empty(0, np.int64), "score": np.empty(0, np.int64)}
        floor, floor_col = np.maximum(least, 1), np.full(items, np.iinfo(np.int64).max)
        while True:
            i, bound = front["item"], front["bound"]
            alive = (bound > floor[i]) | (bound == floor[i]) & (front["col"] << front["size"] <= floor_col[i])
            front = {name: x[alive] for name, x in front.items()}
            if not len(front["item"]):
                return best["item"], best["col"], best["score"]
            order = np.lexsort((front["col"] << front["size"], -front["bound"], front["item"]))
            i = front["item"][order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            now, later = order[nth < WIDTH], order[nth >= WIDTH]
            picked = {name: x[now] for name, x in front.items()}
            # the cells of the picked ranges, and where the halves of each go
            at = places(picked["off"], picked["len"])
            owner = np.repeat(np.arange(len(now)), picked["len"])
            term, cell, size = pool_term[at], pool_cell[at], picked["size"][owner] - 1
            bits, leaf = self.bits[cell], self.bits[cell] == 0
            own_col = self.col[self.leaf[cell] * leaf]
            halves = []
            for half in (0, 1):
                stay = np.flatnonzero(leaf & ((own_col >> size & 1) == half))
                quarter = ((row[term] >> size & 1) << 1 | half).astype(np.uint8)
                go = np.flatnonzero(~leaf & ((bits >> quarter & 1) == 1))
                child = self.first[cell[go]] + _POP[bits[go] & ((1 << quarter[go]) - 1)]
                fits = (self.bits[child] != 0) | (self.row[self.leaf[child]] == row[term[go]])
                go, child = go[fits], child[fits]
                halves.append((owner[stay] * 2 + half, term[stay], cell[stay]))
                halves.append((owner[go] * 2 + half, term[go], child))
            to, term, cell = (np.concatenate(x) for x in zip(*halves))
            sort = np.argsort(to, kind="stable")
            to, term, cell = to[sort], term[sort], cell[sort]
            start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
            owner, half = to[start] >> 1, to[start] & 1
            new = {"item": picked["item"][owner], "col": picked["col"][owner] << 1 | half, "size": picked["size"][owner] - 1,
                   "off": start + used, "len": np.diff(np.append(start, len(to))),
                   "bound": np.add.reduceat(weight[term] * self.top[cell], start) if len(to) else np.empty(0, np.int64)}
            done = new["size"] == 0
            if done.any():
                best = {name: np.concatenate([best[name], new[of][done]]) for name, of in (("item", "item"), ("col", "col"), ("score", "bound"))}
                best = {name: x[best["score"] >= np.maximum(least, 1)[best["item"]]] for name, x in best.items()}
                order = np.lexsort((best["col"], -best["score"], best["item"]))
                best = {name: x[order] for name, x in best.items()}
                nth = np.arange(len(order)) - np.searchsorted(best["item"], best["item"])
                last = np.flatnonzero(nth == k - 1)
                floor[best["item"][last]], floor_col[best["item"][last]] = best["score"][last], best["col"][last]
                best = {name: x[nth < k] for name, x in best.items()}
            front = {name: np.concatenate([front[name][later], new[name][~done]]) for name in front}
            if used + len(term) > len(pool_term):
                more = max(len(pool_term), len(term))
                pool_term, pool_cell = np.append(pool_term, np.empty(more, np.int32)), np.append(pool_cell, np.empty(more, np.int64))
            pool_term[used:used + len(term)], pool_cell[used:used + len(term)] = term, cell
            used += len(term)


class Shard:
    """Collects the postings of documents until it is closed."""

    def __init__(self) -> None:
        self.ids: list = []
        self.words: list[int] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.terms: list[np.ndarray] = []
        self.postings = self.distinct = 0

    def add(self, ids: list, texts: list[list[bytes]]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.empty(int(size.sum()), object)
        flat[:] = [t for text in texts for t in text]
        code, terms = pd.factorize(flat)
        each, tf = np.unique(np.repeat(np.arange(len(texts)), size) * max(1, len(terms)) + code, return_counts=True)
        doc, code = np.divmod(each, max(1, len(terms)))
        self.parts.append((doc + len(self.ids), code + self.distinct, tf))
        self.terms.append(terms)
        self.ids += ids
        self.words += size.tolist()
        self.postings += len(each)
        self.distinct += len(terms)

    def closed(self, number: int, words: int) -> dict | None:
        """The shard as a row; ``number`` and ``words`` are those of all documents."""
        if not self.postings:
            return None
        doc, code, tf = (np.concatenate(x) for x in zip(*self.parts))
        same, terms = pd.factorize(np.concatenate(self.terms))
        code = same[code]
        count = np.bincount(code)
        order = np.argsort(-count, kind="stable")
        row = np.empty(len(terms), np.int64)
        row[order] = np.arange(len(terms))
        by_id = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] if self.ids[i] is not None else 0))
        col = np.empty(len(by_id), np.int64)
        col[by_id] = np.arange(len(by_id))
        m = np.array([100 - 50 + 50 * n * number // words for n in self.words], np.int64)[doc]
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * m)
        treap = Treap.build(row[code], col[doc], impact, max(len(terms), len(self.ids)))
        return {"ids": [self.ids[i] for i in by_id], "terms": [terms[i].decode("utf-8") for i in order],
                "counts": count[order].tolist(), **treap.packed()}


_ARRAYS = {"height": pa.int32(), "bits": pa.binary(), "lower": pa.binary(), "row": pa.binary(), "col": pa.binary()}


def _shards(number: int, words: int, id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema({"ids": pa.list_(id_type), "terms": pa.list_(pa.string()), "counts": pa.list_(pa.int64()), **_ARRAYS})

    def close() -> Iterator[pa.RecordBatch]:
        if row := shard.closed(number, words):
            yield pa.RecordBatch.from_pylist([row], schema)

    shard = Shard()
    for batch in batches:
        held, size, a = [], 0, 0
        ids = batch.column("doc_id").to_pylist()
        for b, text in enumerate(batch.column("text").to_pylist(), 1):
            held.append(terms_of(text))
            size += len(held[-1])
            if size >= WORDS or b == len(batch):
                shard.add(ids[a:b], held)
                held, size, a = [], 0, b
                if shard.postings >= POSTINGS:
                    yield from close()
                    shard = Shard()
    yield from close()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = words = 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            n = len(terms_of(text))
            number += n > 0
            words += n
    yield pa.RecordBatch.from_pydict({"number": [number], "words": [words]})


def index(docs: DataFrame) -> tuple[DataFrame, int]:
    """(the shards of ``docs`` (doc_id, text), written to the shared folder; the number of
    documents with a term). Every row is a document. Nothing is shuffled: a task closes a shard
    after ``POSTINGS`` postings or at its end. Columns: ids in order, nulls last; terms and in how
    many of the shard's documents each is, by falling count; the treap's arrays."""
    texts = docs.select("doc_id", "text")
    total = texts.select("text").mapInArrow(_count, "number long, words long").agg(
        F.coalesce(F.sum("number"), F.lit(0)).alias("number"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    id_type = docs.schema["doc_id"].dataType
    shards = texts.mapInArrow(partial(_shards, total["number"], total["words"], to_arrow_type(id_type)),
                              f"ids array<{id_type.simpleString()}>, terms array<string>, counts array<long>, "
                              "height int, bits binary, lower binary, row binary, col binary")
    return stored(shards, "k2-treaps", blocks=True), total["number"]


def item_terms(items: DataFrame, shards: DataFrame, number: int) -> DataFrame:
    """(item, term, weight) of every different term of each item that some document holds and
    whose weight is above 0."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, t.decode("utf-8")) for i, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist())
                     for t in sorted(set(terms_of(text)))]
            yield pa.RecordBatch.from_pydict({"item": pa.array([i for i, _ in pairs], pa.int64()),
                                              "term": pa.array([t for _, t in pairs], pa.string())})

    terms = items.select("item", "text").mapInArrow(cut, "item long, term string")
    wanted = terms.select("term").distinct()
    counts = (shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("held"))
              .select(F.col("held.terms").alias("term"), F.col("held.counts").alias("n"))
              .join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(float(2 * number + 2)) / (2 * F.col("df") + 1).cast("double")))
    return terms.join(counts, "term").select("item", "term", weight.cast("long").alias("weight")).filter("weight > 0")


def _search(wanted: pd.DataFrame, k: int, id_type: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best documents of each item among a task's shards. What earlier shards gave bounds what
    later ones have to give."""
    own, item = np.unique(wanted["item"].to_numpy(), return_inverse=True)
    weight, terms = wanted["weight"].to_numpy(), wanted["term"].tolist()
    least = np.zeros(len(own) + TOGETHER, np.int64)
    found = {"item": np.empty(0, np.int64), "doc_id": np.empty(0, object), "score": np.empty(0, np.int64)}
    for shard in (row for batch in batches for row in batch.to_pylist()):
        place = dict(zip(shard["terms"], range(len(shard["terms"]))))
        row = np.array([place.get(t, -1) for t in terms], np.int64)
        treap = Treap.unpacked(*(shard[name] for name in _ARRAYS))
        ids = np.empty(len(shard["ids"]), object)
        ids[:] = shard["ids"]
        for a in range(0, len(own), TOGETHER):
            some = (row >= 0) & (item >= a) & (item < a + TOGETHER)
            got = treap.search(item[some] - a, row[some], weight[some], TOGETHER, k, least[a:a + TOGETHER])
            found = {name: np.concatenate([found[name], x]) for name, x in zip(found, (got[0] + a, ids[got[1]], got[2]))}
        order = np.lexsort((-found["score"], found["item"]))  # more than k where the last ones tie
        found = {name: x[order] for name, x in found.items()}
        nth = np.arange(len(order)) - np.searchsorted(found["item"], found["item"])
        last = np.flatnonzero(nth == k - 1)
        least[found["item"][last]] = found["score"][last]
        found = {name: x[found["score"] >= least[found["item"]]] for name, x in found.items()}
    yield pa.RecordBatch.from_arrays([pa.array(own[found["item"]], pa.int64()), pa.array(found["doc_id"].tolist(), id_type),
                                      pa.array(found["score"])], ["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """For each row of ``items`` (item_id, text) the ``k`` rows of ``docs`` (doc_id, text) of
    highest score above 0: item_id, rank (from 1), doc_id, score; equal scores by doc_id, a null
    one last. The score is that of the contract: sums of term weights times saturated counts.

    Items are searched for in blocks of ``ITEMS``, each of which the driver hands to all tasks;
    every shard gives ``k`` documents an item and more only where they tie. Null or blank texts of documents count
    in nothing; items without terms, or whose terms nobody has, have no rows. Repeated rows are
    documents and items of their own; empty tables give no rows; other columns are ignored."""
    shards, number = index(docs)
    items = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-items.count() // ITEMS))
    terms = stored(item_terms(items, shards, number).withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), "item-terms")
    id_type = docs.schema["doc_id"].dataType
    found = None
    for b in range(blocks):
        wanted = terms.filter(F.col("block") == b).drop("block").toPandas().sort_values(["item", "term"], ignore_index=True)
        part = shards.drop("counts").mapInArrow(partial(_search, wanted, k, to_arrow_type(id_type)),
                                                f"item long, doc_id {id_type.simpleString()}, score long")
        part = part if blocks == 1 else stored(part, "found")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
