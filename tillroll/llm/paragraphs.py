"""Repeated passages: MinHash banding of paragraphs.

Paragraphs are lines, and blocks of lines between blank ones. Passages repeat inside lines as well,
so spans of ``SPAN`` words are compared like paragraphs. A span starts at a content-defined word:
one whose trigram hash is the least of ``GAP`` neighbouring ones. Any two texts that share
``SPAN + GAP + 1`` words in a row or more have a span in common. MinHash bands bring similar units
together, the Jaccard similarity of their five-word shingles is verified exactly, and links form
components. What lies in a component with units of several documents is repeated; the document
with the least id keeps it. A repeated unit is then extended word by word to both sides, as far as five-word shingles are common with the
keeper's text, so a passage is one row from its first common word to its last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm import arrays
from tillroll.llm.common import scratch, stored
from tillroll.llm.components import components
from tillroll.llm.hashing import blocks, combine, mix, shingle_hashes, word_hashes, word_places
from tillroll.llm.ngram_join import _store_sets, _verify, connect, hand_on, list_pairs

WIDTH, SPAN, GAP = 5, 20, 28
#: A text of fewer words than a span is one span if it has so many.
LEAST_WORDS = 5
#: No exact common run goes on for more words beside a unit without holding a common span itself.
REACH = SPAN + GAP + 1
THRESHOLD, RECALL = 0.75, 0.95
#: Band keys that a task holds before it hands on what it has.
HELD = 1_500_000


def tune_bands(threshold: float = THRESHOLD, recall: float = RECALL, unrelated: float = 0.05,
               false: float = 0.02) -> tuple[int, int]:
    """(bands, rows): the fewest bands that bring a pair right at the threshold together with the
    given probability and an unrelated pair with no more than ``false``."""
    for bands in range(1, 65):
        for rows in range(8, 0, -1):
            if 1 - (1 - threshold ** rows) ** bands >= recall and 1 - (1 - unrelated ** rows) ** bands <= false:
                return bands, rows
    raise ValueError("no banding reaches this recall")


def _least(values: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where the leftmost least values are of the windows of ``GAP`` among ``count`` values from each of ``at`` on."""
    if not len(at):
        return np.empty(0, np.int64)
    place, width = np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1
    while width < GAP:  # the leftmost least of two overlapping windows
        step = min(width, GAP - width)
        place = np.where(values[step:] < values[:-step], place[step:], place[:-step])
        values = np.minimum(values[step:], values[:-step])
        width += step
    windows = count - GAP + 1
    place = place[np.repeat(at - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())]
    return place[np.concatenate([[True], place[1:] != place[:-1]])].astype(np.int64)


def anchors(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word in it) of the spans of texts of hashed words, in order, ``bounds`` being
    where the texts' words start, and the end."""
    n = np.diff(bounds)
    if not (n >= SPAN).any():
        short = np.flatnonzero(n >= LEAST_WORDS)
        return short, np.zeros(len(short), np.int64)
    tri = combine(combine(words[:-2], words[1:-1]), words[2:])
    place = _least(tri, bounds[:-1][n - 2 >= GAP], n[n - 2 >= GAP] - 2)
    few = (n >= SPAN) & (n - 2 < GAP)  # words of one narrower window
    if few.any():
        at, count = bounds[:-1][few], n[few] - 2
        edges = np.cumsum(count) - count
        within = np.repeat(at - edges, count) + np.arange(count.sum())
        least = np.minimum.reduceat(tri[within], edges)
        hit = np.flatnonzero(tri[within] == np.repeat(least, count))
        place = np.sort(np.concatenate([place, within[hit[np.searchsorted(hit, edges)]]]))
    text = np.searchsorted(bounds, place, "right") - 1
    start = place - bounds[text]
    fits = start <= n[text] - SPAN
    text, start = text[fits], start[fits]
    some = n >= LEAST_WORDS
    some[text] = False
    bare = np.flatnonzero(some)
    text, start = np.concatenate([text, bare]), np.concatenate([start, np.zeros(len(bare), np.int64)])
    order = np.argsort(text, kind="stable")
    return text[order], start[order]


def paragraphs(edges: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the lines and of the blocks of lines of texts, given where the words of their
    lines start and the last one's end, and each line's text. A text without inner blank lines has no blocks."""
    start, end = edges[:-1], edges[1:]
    used = start < end
    block, of, start, end = np.cumsum(~used)[used], of[used], start[used], end[used]
    if len(start):
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (of[1:] != of[:-1])]))
        last = np.append(first[1:], len(start)) - 1
        several = np.bincount(of[first])[of[first]] > 1
        start, end = np.concatenate([start, start[first[several]]]), np.concatenate([end, end[last[several]]])
    long = end - start >= LEAST_WORDS
    return start[long], end[long]


class Units(NamedTuple):
    """What a block's texts are compared by; a unit's shingles are ``size - WIDTH + 1`` of ``runs`` from ``at`` on."""
    row: np.ndarray  # of the batch
    start: np.ndarray  # first word
    size: np.ndarray  # words
    digest: np.ndarray
    salt: np.ndarray  # 0 of a paragraph; of a span its first words, which neighbouring spans don't share
    at: np.ndarray
    runs: np.ndarray  # of all texts of the block

    def only(self, keep: np.ndarray) -> Units:
        return Units(*(x[keep] for x in self[:6]), self.runs)

    def shingles(self, i: int) -> np.ndarray:
        return self.runs[self.at[i]:self.at[i] + self.size[i] - WIDTH + 1]


def _digests(runs: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of units of ``count`` shingles of ``runs`` from ``begin`` on, by shingles and places."""
    places, out = mix(np.arange(count.max(), dtype=np.uint64)), np.empty(len(begin), np.uint64)
    width = SPAN - WIDTH + 1
    full = count == width  # most are whole spans: a row each
    if full.any():
        rows = np.lib.stride_tricks.sliding_window_view(runs, width)[begin[full]]
        out[full] = mix(rows ^ places[:width]).sum(axis=1)
    if not full.all():
        begin, n = begin[~full], count[~full]
        edges = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(edges, n)
        out[~full] = np.add.reduceat(mix(runs[np.repeat(begin, n) + place] ^ places[place]), edges)
    return mix(out + count.astype(np.uint64))


def _units(batch: pd.DataFrame) -> Iterator[tuple[Units, dict[int, np.ndarray]]]:
    """The spans and paragraphs of a block, equal ones once, and the shingles of each row that has any, in order."""
    for first, held in blocks(batch["text"]):
        split = [text.split(b"\n") for text in held]
        words, lines = word_hashes([line for text in split for line in text])
        of = np.fromiter(map(len, split), np.int64, len(split))
        bounds = lines[np.concatenate([[0], np.cumsum(of)])]
        runs, at = shingle_hashes(words, bounds, WIDTH)
        text, own = anchors(words, bounds)
        if len(text):
            spans = bounds[text] + own << 32 | np.minimum(SPAN, bounds[text + 1] - bounds[text] - own)
            start, end = paragraphs(lines, np.repeat(np.arange(len(held)), of))
            whole = start << 32 | end - start
            unit = np.sort(np.concatenate([spans, whole]), kind="stable")  # both are nearly in order
            unit = unit[np.concatenate([[True], unit[1:] != unit[:-1]])]
            start, size = unit >> 32, unit & 0xFFFFFFFF
            row = np.searchsorted(bounds, start, "right") - 1
            start -= bounds[row]
            begin = at[row] + start
            count = size - WIDTH + 1
            salt = runs[begin] | np.uint64(1)
            salt[np.searchsorted(unit, whole)] = 0
            yield (Units(first + row, start, size, _digests(runs, begin, count).view(np.int64), salt, begin, runs),
                   {first + i: runs[at[i]:at[i + 1]] for i in row[np.concatenate([[True], row[1:] != row[:-1]])].tolist()})


def band_keys(units: Units, bands: int, rows: int) -> np.ndarray:
    """(units, bands). Spans meet only where they start alike: an edit in the words by which they
    are found gives other spans anyway, and neighbours that overlap are no candidates."""
    between = np.stack([units.at, units.at + units.size - WIDTH + 1], axis=1).ravel()
    runs = np.append(units.runs, np.uint64(0))  # a unit may end with the last run
    out = []
    for b in range(bands):
        key = combine(np.full(len(units.at), b, np.uint64), units.salt)
        for r in range(rows):
            seed = mix(np.array([b * rows + r + 1], np.uint64))
            key = combine(key, np.minimum.reduceat(mix(runs ^ seed), between)[::2])
        out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def _list(bands: int, rows: int, only: tuple[str, int] | None, shards: int,
          batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Band keys of the spans of a task, of all or of those in the store ``only``. Without it also
    kind 2: each span with its least and greatest document."""
    keys, spans, docs, salts = [], [], [], []
    size = 0

    def listed() -> Iterator[pd.DataFrame]:
        if not spans:
            return
        span, key, doc, salt = (np.concatenate(x) for x in (spans, keys, docs, salts))
        for x in (spans, keys, docs, salts):
            x.clear()
        order = np.argsort(span.view(np.uint64))
        span, doc, salt = span[order], doc[order], salt[order]
        first = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
        plain = np.flatnonzero(salt == np.repeat(np.minimum.reduceat(salt, first), np.diff(np.append(first, len(span)))))
        key = key[order[plain[np.searchsorted(plain, first)]]]  # a span that is a paragraph elsewhere is listed as one
        span = span[first]
        if not only:
            least, most = np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)
            shard = arrays.shard_of(span.view(np.uint64), shards)
            edges = np.searchsorted(shard, np.arange(shards + 1))
            for s in range(shards):
                own = slice(edges[s], edges[s + 1])
                if edges[s + 1] > edges[s]:
                    yield arrays.packed_pairs(2, s, span[own], least[own], most[own])
        cls, key = np.repeat(span, key.shape[1]), key.ravel().view(np.uint64)
        yield from hand_on(key, cls, shards, bool(only))

    for batch in batches:
        ids = batch["row"].to_numpy()
        for units, _ in _units(batch):
            if only:
                units = units.only(arrays.find(*only, units.digest.view(np.uint64))[0])
            if len(units.row):
                keys.append(band_keys(units, bands, rows))
                salts.append(units.salt)
                spans.append(units.digest)
                docs.append(ids[units.row])
                size += keys[-1].size
            if size > HELD:
                yield from listed()
                size = 0
    yield from listed()


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What tasks list, by shard -> kind 0: pairs (a > b) of spans; kind 2: each span with its least
    and greatest document."""
    for _, rows in arrays.by_shard(batches):
        about = [r for r in rows if r.kind == 2]
        if (found := list_pairs(rows)) is not None:
            yield _rows(0, found["a"], found["b"], 0)
        rows.clear()
        if not about:
            continue
        span, least, most = (np.concatenate([np.frombuffer(getattr(r, n), np.int64) for r in about])
                             for n in ("keys", "classes", "more"))
        about.clear()
        order = np.argsort(span)
        span = span[order]
        first = np.flatnonzero(np.concatenate([[True], span[1:] != span[:-1]]))
        yield _rows(2, span[first], np.minimum.reduceat(least[order], first), np.maximum.reduceat(most[order], first))


def _rows(kind: int, a, b, c) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.int32(kind), "a": a, "b": b, "c": np.int64(c) if np.isscalar(c) else c})


def doc_key(ids: np.ndarray) -> np.ndarray:
    """Spread over all shards."""
    return mix(ids.astype(np.int64).view(np.uint64))


def _doc_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": doc_key(batch["row"].to_numpy()).view(np.int64)})


def _store_docs(rows: DataFrame, what: str) -> tuple[str, int]:
    """A store of the keys of the documents in ``rows`` (row)."""
    rows = stored(rows.distinct(), what)
    store = (scratch(rows.sparkSession, f"{what}-store"), arrays.shards_for(rows.count()))
    arrays.store_sorted(rows.mapInPandas(_doc_keys, "key long"), *store)
    return store


def _among(docs: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of documents in a store of their keys: others are not cut into units."""
    for batch in batches:
        held = arrays.find(*docs, doc_key(batch["row"].to_numpy()))[0]
        if held.any():
            yield batch[held]


def _emit_sets(wanted: tuple[str, int], docs: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, set) of wanted spans, from the least document that has them, which are in ``docs``."""
    seen: set[int] = set()
    for batch in _among(docs, batches):
        ids = batch["row"].to_numpy()
        for units, _ in _units(batch):
            digest = units.digest
            have = arrays.find(*wanted, digest.view(np.uint64))[0]
            have[have] = arrays.lookup(*wanted, digest[have].view(np.uint64), "row", np.int64, 0) == ids[units.row[have]]
            take = []
            for i in np.flatnonzero(have):
                if digest[i] not in seen:
                    seen.add(digest[i])
                    take.append(i)
            if len(seen) > HELD:
                seen.clear()
            if take:
                yield pd.DataFrame({"class": digest[take], "shingles": [
                    np.unique(units.shingles(i)).tobytes() for i in take]})


def _marked(marked: tuple[str, int], batch: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, dict[int, np.ndarray]]]:
    """(row of the batch, its shingles, by keeper the first words, ends and components of its repeated
    units, in order of the first words)."""
    for units, shingles in _units(batch):
        found, shard, place = arrays.find(*marked, units.digest.view(np.uint64))
        units = units.only(found)
        if not len(units.row):
            continue
        part, keeper = (arrays.values(*marked, name, np.int64, shard[found], place[found]) for name in ("component", "keeper"))
        order = np.lexsort((keeper, units.row))  # stable
        row, keeper = units.row[order], keeper[order]
        about = np.stack([units.start, units.start + units.size, part])[:, order]
        edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (keeper[1:] != keeper[:-1])])).tolist()
        now, by_keeper = row[0], {}
        for a, b in zip(edges, [*edges[1:], len(row)]):
            if row[a] != now:
                yield int(now), shingles[now], by_keeper
                now, by_keeper = row[a], {}
            by_keeper[int(keeper[a])] = about[:, a:b]
        yield int(now), shingles[now], by_keeper


def _emit_near(marked: tuple[str, int], docs: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class: the document's key, shingles) of keepers, which are in ``docs``: what lies within ``REACH`` words of
    what they keep."""
    for batch in _among(docs, batches):
        ids, keys, sets = batch["row"].to_numpy(), [], []
        for r, shingles, by_keeper in _marked(marked, batch):
            if (units := by_keeper.get(int(ids[r]))) is not None:
                near = _covered(len(shingles), np.maximum(units[0] - REACH, 0), np.minimum(units[1] + REACH, len(shingles)))
                keys.append(ids[r])
                sets.append(np.unique(shingles[near]).tobytes())
        if keys:
            yield pd.DataFrame({"class": doc_key(np.array(keys)).view(np.int64), "shingles": sets})


def _store_near(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows that repeat an id have their shingles together."""
    held: dict[int, dict[int, bytes]] = {}
    for batch in batches:
        for shard, key, data in zip(batch["shard"].tolist(), batch["class"].tolist(), batch["shingles"]):
            own = held.setdefault(shard, {})
            own[key] = np.unique(np.frombuffer(own[key] + data, np.uint64)).tobytes() if key in own else data
    for shard, own in held.items():
        keys = np.sort(np.fromiter(own, np.int64, len(own)).view(np.uint64))
        sets = [own[k] for k in keys.view(np.int64).tolist()]
        arrays.write(folder, "key", shard, keys)
        arrays.write(folder, "end", shard, np.cumsum([len(x) // 8 for x in sets]))
        arrays.write(folder, "data", shard, np.frombuffer(b"".join(sets), np.uint64))
        yield pd.DataFrame({"rows": [len(own)]})


def _near(store: tuple[str, int], keepers: set[int]) -> dict[int, tuple[np.uint64, np.ndarray]]:
    """Each keeper's key and shingles; none of one that the store lacks."""
    ids = np.fromiter(keepers, np.int64, len(keepers))
    keys, out = doc_key(ids), {}
    for k, key, found, shard, at in zip(ids.tolist(), keys, *(x.tolist() for x in arrays.find(*store, keys))):
        own = np.empty(0, np.uint64)
        if found:
            end = arrays.mapped(store[0], "end", shard, np.int64)
            own = np.asarray(arrays.mapped(store[0], "data", shard, np.uint64))[end[at - 1] if at else 0:end[at]]
        out[k] = key, own
    return out


def _runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of true."""
    held = np.zeros(len(mask) + 2, bool)
    held[1:-1] = mask
    edge = np.flatnonzero(held[1:] != held[:-1])
    return edge[::2], edge[1::2]


def _covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` places lie in an interval."""
    return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:-1] > 0


def _extend(words: int, first: np.ndarray, end: np.ndarray, units: np.ndarray) -> np.ndarray:
    """First words, ends, components and numbers of units of what the common runs of words from ``first``
    to ``end`` and the units cover together, where a unit is in it."""
    starts, ends = _runs_of(_covered(words, np.concatenate([first, units[0]]), np.concatenate([end, units[1]])))
    at = np.searchsorted(starts, units[0], "right") - 1
    fresh = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return np.stack([starts[at[fresh]], ends[at[fresh]], np.minimum.reduceat(units[2], fresh), np.diff(np.append(fresh, len(at)))])


_FOUND = ["kind", "row", "start", "end", "n_words", "n_spans", "component_id", "keeper", "kept", "key", "last"]


def _passages(row: int, text: str, found: list[tuple], kept: bool) -> list[tuple]:
    """Of (first word, end, component, units, keeper) those that overlap or meet as one."""
    starts, ends = word_places(text)
    merged: list[list[int]] = []
    for s, e, c, n, k in sorted(found):
        if merged and s <= merged[-1][1]:
            last = merged[-1]
            last[1], last[2], last[3] = max(e, last[1]), min(c, last[2]), last[3] + n
        else:
            merged.append([s, e, c, n, k])
    return [(0, row, int(starts[s]), int(ends[e - 1]), e - s, n, c, k, kept, 0, 0) for s, e, c, n, k in merged]


def _remove(marked: tuple[str, int], near: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind 0: passages that others keep, word by word as far as they agree with the keeper; kind 1:
    the runs of shingles (n_words of them) that they share with it: a key of keeper and first
    one, the last one."""
    for batch in batches:
        ids, texts, out = batch["row"].to_numpy(), batch["text"].to_numpy(), []
        shared: list[tuple] = []
        rows = [(r, shingles, {k: units for k, units in by_keeper.items() if k != ids[r]})
                for r, shingles, by_keeper in _marked(marked, batch)]
        keepers = _near(near, {k for _, _, by_keeper in rows for k in by_keeper})
        for r, shingles, by_keeper in rows:
            found = []
            for k, units in by_keeper.items():
                key, own = keepers[k]
                place = np.searchsorted(own, shingles)
                first, end = _runs_of(own[np.minimum(place, len(own) - 1)] == shingles if len(own) else np.zeros(len(shingles), bool))
                extended = _extend(len(shingles) + WIDTH - 1, first, end + WIDTH - 1, units)
                found += [(*x, k) for x in extended.T.tolist()]
                inside = np.searchsorted(extended[0], first, "right") - 1
                take = (inside >= 0) & (first < extended[1][inside])
                first, end = first[take], end[take]
                shared.append((np.full(len(first), key), shingles[first], end - first, shingles[end - 1]))
            if found:
                out += _passages(ids[r], texts[r], found, False)
        if shared:
            key, start, n, last = map(np.concatenate, zip(*shared))
            key, last = combine(key, start).view(np.int64), last.view(np.int64)
            order = np.lexsort((last, n, key))
            most = order[np.append(key[order[1:]] != key[order[:-1]], True)[:len(order)]]  # the longest of a key, then the greatest last
            out += [(1, 0, 0, 0, n, 0, 0, 0, False, key, last) for key, n, last in zip(
                key[most].tolist(), n[most].tolist(), last[most].tolist())]
        if out:
            yield pd.DataFrame(out, columns=_FOUND)


def _keep(marked: tuple[str, int], docs: tuple[str, int], shared: tuple[str, int],
          batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Passages that a document, if in ``docs``, keeps, as far as any other document shares them."""
    for batch in _among(docs, batches):
        ids, texts, out = batch["row"].to_numpy(), batch["text"].to_numpy(), []
        for r, shingles, by_keeper in _marked(marked, batch):
            if (units := by_keeper.get(int(ids[r]))) is not None:
                keys = combine(np.full(len(shingles), doc_key(ids[r:r + 1])[0]), shingles)
                first, shard, place = arrays.find(*shared, keys)
                first = np.flatnonzero(first)
                n, last = (arrays.values(*shared, name, np.int64, shard[first], place[first]) for name in ("n", "last"))
                fits = first + n <= len(shingles)
                first, n, last = first[fits], n[fits], last[fits]
                same = shingles.view(np.int64)[first + n - 1] == last
                first, n = first[same], n[same]
                found = _extend(len(shingles) + WIDTH - 1, first, first + n + WIDTH - 1, units)
                out += _passages(ids[r], texts[r], [(*x, ids[r]) for x in found.T.tolist()], True)
        if out:
            yield pd.DataFrame(out, columns=_FOUND)


def find(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each repeated passage of each row of ``docs`` (doc_id, text): doc_id, start, end
    (code points, end exclusive), n_words, n_spans, component_id, keeper, kept.

    A passage is kept in the document with the least id of its component and removed (kept
    false) in all others, from the first to the last word that it has in common with the keeper's
    (in the keeper: with any other's); overlapping passages with one verdict are one. Documents without
    repeated passages have no row, nor have null, empty and shorter texts than ``LEAST_WORDS``.
    Repeats within one document don't count. Rows with a null id are read as a document of
    their own whose doc_id is null, and keep nothing that others have. Repeated rows with one id
    are one document. An empty table gives no rows; other columns are ignored.

    Lists of band keys are paired with their least span first; only where such a pair fails are
    they listed again in full, and pairs between components verified. Pairs within one document are
    links as well: a list's least unit may be in the document of another. Texts are read five
    times, or six, in three of these only those of documents that stand for a unit or keep one; what is shuffled are hashes. A passage in a third of all documents is counted
    once per task before it is shuffled."""
    if threshold != THRESHOLD:
        raise ValueError("the exact check is fixed at 3/4")
    spark = docs.sparkSession
    bands, rows = tune_bands(threshold, recall)
    last, top = 2 ** 63 - 1, F.shiftrightunsigned("class", 32)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("row"), "text")
    # a span for about every 14 words of 6 characters and some paragraphs, each under all its bands
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = arrays.shards_for(size // 70 * bands)
    listed = texts.mapInPandas(partial(_list, bands, rows, None, shards), arrays.LISTED)
    settled = stored(listed.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInPandas(
        _settle, "kind int, a long, b long, c long"), "para-lists")
    spans = settled.where("kind = 2").select(F.col("a").alias("class"), F.col("b").alias("least"), F.col("c").alias("greatest"))
    pairs = stored(settled.where("kind = 0").select("a", "b").distinct(), "para-pairs")
    members = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(spans, "class"), "para-members")
    n = members.count()
    found = None
    if n:
        wanted = (scratch(spark, "para-wanted"), arrays.shards_for(n))
        arrays.store_sorted(members.select(F.col("class").alias("key"), F.col("least").alias("row")), *wanted, {"row": np.int64})
        sets = (scratch(spark, "para-set-store"), arrays.shards_for(n, 100_000))
        holders = _store_docs(members.select(F.col("least").alias("row")), "para-holders")
        emitted = texts.mapInPandas(partial(_emit_sets, wanted, holders), "class long, shingles binary")
        with arrays.tidy(spark):
            emitted.withColumn("shard", F.shiftrightunsigned(top * F.lit(sets[1]).cast("long"), 32).cast("int")).repartitionById(
                sets[1], "shard").mapInPandas(partial(_store_sets, sets[0]), "rows long").agg(F.sum("rows")).first()
        verify = partial(_verify, sets)
        checked = stored(pairs.repartition("a", "b").mapInPandas(verify, "a long, b long, ok boolean"), "para-checked")
        found = stored(components(checked.where("ok").select("a", "b")), "para-components")
        placed = stored(members.join(found.withColumnRenamed("id", "class"), "class", "left").withColumn(
            "component", F.coalesce("component", "class")), "para-placed")
        failed = checked.where("not ok").select(F.explode(F.array("a", "b")).alias("class")).distinct()
        again = stored(placed.join(failed.join(placed, "class").select("component").distinct(), "component")
                       .select("class", "component"), "para-open")
        n_open = again.count()
        if n_open:
            only = (scratch(spark, "para-open-store"), arrays.shards_for(n_open))
            arrays.store_sorted(again.select(F.col("class").alias("key")), *only)
            relisted = texts.mapInPandas(partial(_list, bands, rows, only, shards), arrays.LISTED)
            found = connect(relisted, shards, again, found, sets)
    if found is None:
        marked = spans.where("least != greatest").select(
            F.col("class").alias("key"), F.col("class").alias("component"), F.col("least").alias("keeper"))
    else:
        own = spans.join(found.withColumnRenamed("id", "class"), "class", "left")
        alone = own.where("component is null and least != greatest").select(
            F.col("class").alias("key"), F.col("class").alias("component"), F.col("least").alias("keeper"))
        grouped = own.where("component is not null")
        keepers = grouped.groupBy("component").agg(F.min("least").alias("keeper"), F.max("greatest").alias("g")).where("keeper != g")
        marked = alone.unionByName(grouped.join(keepers.drop("g"), "component").select(
            F.col("class").alias("key"), "component", "keeper"))
    marked = stored(marked, "para-marked")
    store = (scratch(spark, "para-marked-store"), arrays.shards_for(marked.count()))
    arrays.store_sorted(marked, *store, {"component": np.int64, "keeper": np.int64})
    near = (scratch(spark, "para-near"), arrays.shards_for(size // 6))  # a shingle a word, of all documents at most
    keeping = _store_docs(marked.select(F.col("keeper").alias("row")), "para-keepers")
    emitted = texts.mapInPandas(partial(_emit_near, store, keeping), "class long, shingles binary")
    with arrays.tidy(spark):
        emitted.withColumn("shard", F.shiftrightunsigned(top * F.lit(near[1]).cast("long"), 32).cast("int")).repartitionById(
            near[1], "shard").mapInPandas(partial(_store_near, near[0]), "rows long").agg(F.sum("rows")).first()
    schema = ("kind int, row long, start int, end int, n_words int, n_spans int, component_id long, keeper long, "
              "kept boolean, key long, last long")
    removed = stored(texts.mapInPandas(partial(_remove, store, near), schema), "para-removed")
    runs = stored(removed.where("kind = 1").groupBy("key").agg(F.max(F.struct("n_words", "last")).alias("most")).select(
        "key", F.col("most.n_words").cast("long").alias("n"), "most.last"), "para-runs")
    shared = (scratch(spark, "para-shared"), arrays.shards_for(runs.count()))
    arrays.store_sorted(runs, *shared, {"n": np.int64, "last": np.int64})
    located = removed.where("kind = 0").unionByName(texts.mapInPandas(partial(_keep, store, keeping, shared), schema))
    return located.drop("kind", "key", "last").withColumn("row", F.when(F.col("row") < last, F.col("row"))).withColumnRenamed("row", "doc_id")


def expected_recall(bands: int, rows: int, similarity: float) -> float:
    return 1 - math.pow(1 - similarity ** rows, bands)
