"""N-gram Jaccard join: documents whose sets of word shingles overlap, exactly.

The join is size-aware. Sets of up to X shingles are light: each enumerates its 2-subsets of
rare shingles, and two light sets that link share one. Larger sets are heavy and scan inverted
lists of single rare shingles. X is where the estimated cost of both parts is least. A link
has sizes within 3/4 of each other, so sets above 3/4 X enter the inverted lists as well and no
pair across the boundary is lost.

Why that finds every link: if J(A, B) >= t, then |A & B| >= t max(|A|, |B|). In any common order
of all shingles the first |A| - ceil(t |A|) + k of A and the like of B share k shingles at
least. The order puts shingles that many sets have last, so lists stay short.

Lists are not turned into all their pairs. Each member is first paired with the list's least
one. Pairs are verified on the whole sets. Where all of a group's pairs hold, it is connected
and done. Only groups with a pair that failed are listed again, and there the task that holds a
list compares its classes of different components, long lists as rows of bits; it hands on
only links that join components. Sets that are equal are one class throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import arrays
from tillroll.llm.common import scratch, stored
from tillroll.llm.components import components
from tillroll.llm.hashing import blocks, combine, mix, shingle_sets

WIDTH = 5
#: The threshold as a fraction.
NUM, DEN = 3, 4
#: A shingle that so many sets have (by counts of 2 or more within a task) comes last in the order.
COMMON = 16
#: Light sets have at most so many shingles.
MOST_LIGHT = 64
#: Lists of up to so many classes give their pairs, each of which a task compares once; longer ones are
#: compared in blocks of so many shingles.
SHORT, BLOCK = 16, 200_000
#: Entries (key, class) of a shard of lists.
ENTRIES = 400_000
#: Shingles (and classes) that a task holds before it hands on what it has.
HELD = 1_000_000
_ROWS = "kind int, a long, b long, c long"
_LIGHT = np.uint64(0x51ED270B7F3A9C15)


def overlap_needed(n):
    """The least overlap of a set of n with any set it links with."""
    return -(-NUM * n // DEN)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit digest of the set, signed; equal sets are one class."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pd.DataFrame) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """(rows of the batch, their sets), block by block."""
    for first, held in blocks(batch["text"]):
        yield list(range(first, first + len(held))), shingle_sets(held, WIDTH)


def _columns(kind: int, *columns) -> pd.DataFrame:
    n = len(columns[0])
    wide = [*columns, *[np.zeros(n, np.int64)] * (3 - len(columns))]
    return pd.DataFrame({"kind": np.full(n, kind, np.int32), **{k: v for k, v in zip("abc", wide)}})


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Kind 0: (row id, n, class) of each document; kind 1: (shingle, sets of this task that
    have it), from 2 on."""
    arrays.work_for("ngram_join")
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pd.DataFrame:
        keys, n = np.unique(np.concatenate(held) if held else np.empty(0, np.uint64), return_counts=True)
        held.clear()
        return _columns(1, keys[n > 1].view(np.int64), n[n > 1])

    for batch in batches:
        rows = batch["row"].to_numpy()
        for at, sets in _sets(batch):
            classes = [class_of(s) for s in sets]
            yield _columns(0, rows[at], np.array([len(s) for s in sets], np.int64), np.array(classes, np.int64))
            for c, s in zip(classes, sets):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size > HELD:
                yield counted()
                seen.clear()
                size = 0
    yield counted()


def _prefixes(sets: list[np.ndarray], common: tuple[str, int]) -> Iterator[np.ndarray]:
    """Of each set the part of its shingles that k = 2 needs, in the common order."""
    everything = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    last = arrays.find(*common, everything)[0] if common[1] else np.zeros(len(everything), bool)
    at = 0
    for s in sets:
        late = last[at:at + len(s)]
        at += len(s)
        yield np.concatenate([s[~late], s[late]])[:len(s) - overlap_needed(len(s)) + 2]


def signatures(prefix: np.ndarray, n: int, light: int) -> list[np.ndarray]:
    """What a set of n shingles is listed under. Sets of one shingle link with equal ones only."""
    out = []
    if 1 < n <= light:
        i, j = np.triu_indices(len(prefix), 1)
        out.append(combine(prefix[i] ^ _LIGHT, prefix[j]))
    if n > 1 and n * DEN > light * NUM:
        out.append(prefix[:n - overlap_needed(n) + 1])
    return out


def hand_on(keys: np.ndarray, classes: np.ndarray, shards: int, whole: bool) -> Iterator[pd.DataFrame]:
    """What a task lists (key, class), for the shuffle. Kind 0: each key with its least class of
    this task, kind 1: the other classes paired with that one; if ``whole``, kind 0: all of it."""
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    if whole:
        yield from arrays.packed_lists(keys, classes, shards)
        return
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    yield from arrays.packed_lists(keys[first], classes[first], shards)
    least = classes[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = classes != least
    if other.any():
        pairs = np.unique(np.stack([classes[other], least[other]]), axis=1)
        yield arrays.packed_pairs(1, int(keys[0]) % shards, pairs[0], pairs[1])


def _list(common: tuple[str, int], light: int, only: tuple[str, int] | None, shards: int,
          batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Signatures of the sets of a task, of all or of those in the store ``only``."""
    arrays.work_for("ngram_join")
    seen: set[int] = set()
    keys: list[np.ndarray] = []
    own: list[np.ndarray] = []
    size = 0

    def listed() -> Iterator[pd.DataFrame]:
        if keys:
            key, cls = np.concatenate(keys), np.concatenate(own)
            keys.clear()
            own.clear()
            yield from hand_on(key, cls, shards, bool(only))

    for batch in batches:
        for _, sets in _sets(batch):
            fresh = {}
            for s in sets:
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    fresh[c] = s
            if only and fresh:
                ids = np.array(list(fresh), np.int64)
                known = arrays.find(*only, ids.view(np.uint64))[0]
                fresh = {c: fresh[c] for c in ids[known].tolist()}
            for (c, s), prefix in zip(fresh.items(), _prefixes(list(fresh.values()), common)):
                for sig in signatures(prefix, len(s), light):
                    keys.append(sig)
                    own.append(np.full(len(sig), c, np.int64))
                    size += len(sig)
            if size > HELD:
                yield from listed()
                seen.clear()
                size = 0
    yield from listed()


def _lists(rows: list) -> tuple[np.ndarray, np.ndarray] | None:
    """(where each list starts, classes list by list) of a shard's rows."""
    lists = [arrays.unpacked_list(r) for r in rows if r.kind == 0]
    if not lists:
        return None
    keys, classes = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((classes, keys))
    keys, classes = keys[order], classes[order]
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), classes


def _distinct(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate(x) for x in zip(*held))
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def list_pairs(rows: list) -> pd.DataFrame | None:
    """Of a shard's rows the pairs (a > b): each class with its list's least one."""
    done = [(np.frombuffer(r.keys, np.int64), np.frombuffer(r.classes, np.int64)) for r in rows if r.kind == 1]
    if found := _lists(rows):
        start, classes = found
        least = np.repeat(classes[start], np.diff(np.append(start, len(classes))))
        other = classes != least
        done.append((classes[other], least[other]))
    return _distinct(done) if done else None


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed lists by shard -> pairs (a > b)."""
    for _, rows in arrays.by_shard(batches):
        if (found := list_pairs(rows)) is not None:
            yield found


class Groups:
    """Components that a task knows to be linked."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        top = x
        while self.up[top] != top:
            top = self.up[top]
        while self.up[x] != top:
            self.up[x], x = top, self.up[x]
        return top

    def roots(self, parts: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.find, parts.tolist()), np.int64, len(parts))


def bit_rows(sets: list[np.ndarray]) -> np.ndarray:
    """A row of bits per set, with a bit for every shingle that two of the sets have; what is in one
    only is in no intersection."""
    keys, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[at] > 1
    bit, owner = number[at[shared]], owner[shared]
    out = np.zeros((len(sets), max(1, -(-int((count > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


class Settler:
    """Finds the links between components among the classes of one shard's lists, by exact
    comparison. It hands on only links that join two components, so at most one less than there are."""

    def __init__(self, ids: np.ndarray, parts: np.ndarray, sets: tuple[str, int]) -> None:
        self.ids, self.part = ids, np.unique(parts, return_inverse=True)[1]
        self.groups = Groups(int(self.part.max()) + 1)
        self.links: list[tuple[int, int]] = []
        self.get = set_reader(sets, ids)

    def join(self, a: int, b: int) -> int:
        x, y = self.groups.find(self.part[a]), self.groups.find(self.part[b])
        self.groups.up[y] = x
        self.links.append((a, b))
        return x

    def short(self, lists: list[np.ndarray]) -> None:
        """Lists of few classes: their pairs, each one once."""
        pairs = []
        for n in {len(x) for x in lists}:
            own = np.stack([x for x in lists if len(x) == n])
            i, j = np.triu_indices(n, 1)
            pairs.append(np.stack([own[:, i].ravel(), own[:, j].ravel()], 1))
        if not pairs:
            return
        both = np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0)
        for a, b in both[self.part[both[:, 0]] != self.part[both[:, 1]]].tolist():
            if self.groups.find(self.part[a]) != self.groups.find(self.part[b]) and linked(self.get(a), self.get(b)):
                self.join(a, b)

    def long(self, members: np.ndarray) -> None:
        """A list of many classes: blocks by size against each other, as rows of bits."""
        sets = {m: self.get(m) for m in members.tolist()}
        order = sorted(sets, key=lambda m: len(sets[m]))
        blocks, held = [[]], 0
        for m in order:
            if held and held + len(sets[m]) > BLOCK:
                blocks.append([])
                held = 0
            blocks[-1].append(m)
            held += len(sets[m])
        for i, one in enumerate(blocks):
            for other in blocks[i:]:
                if len(sets[one[-1]]) * DEN < len(sets[other[0]]) * NUM:
                    break
                self.blocks(one, [] if other is one else other, sets)

    def blocks(self, one: list[int], other: list[int], sets: dict[int, np.ndarray]) -> None:
        both = [*one, *other]
        root = self.groups.roots(self.part[both])
        if (root == root[0]).all():
            return
        bits, n = bit_rows([sets[m] for m in both]), np.array([len(sets[m]) for m in both])
        for i in range(len(one)):
            j = np.arange(i + 1, len(one)) if not other else np.arange(len(one), len(both))
            j = j[(root[j] != root[i]) & (np.minimum(n[j], n[i]) * DEN >= np.maximum(n[j], n[i]) * NUM)]
            if not len(j):
                continue
            common = np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
            for k in j[common * DEN >= NUM * (n[i] + n[j] - common)]:
                if root[k] != root[i]:
                    old = root[[i, k]]
                    root[np.isin(root, old)] = self.join(both[i], both[k])


def _settle(parts: tuple[str, int], sets: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed whole lists by shard -> links (a > b) that join components."""
    for _, rows in arrays.by_shard(batches):
        found = _lists(rows)
        rows.clear()
        if not found:
            continue
        start, classes = found
        part = arrays.lookup(*parts, classes.view(np.uint64), "component", np.int64, 0)
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(classes))))
        keep = np.logical_or.reduceat(part != part[start][run], start)[run]  # most lists lie in one component
        run, classes, part = run[keep], classes[keep], part[keep]
        if not len(run):
            continue
        ids, first, at = np.unique(classes, return_index=True, return_inverse=True)
        settler = Settler(ids, part[first], sets)
        fresh = np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1])])  # several tasks may list a class
        run, at = run[fresh], at[fresh]
        edges = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1], [True]]))
        lists = {x.tobytes(): x for x in (at[s:e] for s, e in zip(edges[:-1], edges[1:]))}.values()
        settler.short([x for x in lists if 1 < len(x) <= SHORT])
        for members in sorted([x for x in lists if len(x) > SHORT], key=len, reverse=True):
            settler.long(members)
        if settler.links:
            a, b = ids[np.array(settler.links).T]
            yield pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def connect(relisted: DataFrame, shards: int, placed: DataFrame, found: DataFrame, sets: tuple[str, int]) -> DataFrame:
    """(id, component) after all pairs between components of the listed classes are settled.

    ``relisted`` has whole packed lists, ``placed`` their classes (class, component), ``found`` the
    components so far, ``sets`` the store of the classes' sets. Every pair of a list whose components
    differ is compared in the task that holds the list, unless links found before join them;
    only links that join components leave it."""
    spark = relisted.sparkSession
    parts = (scratch(spark, "list-parts"), arrays.shards_for(placed.count()))
    arrays.store_sorted(placed.select(F.col("class").alias("key"), "component"), *parts, {"component": np.int64})
    spread = relisted.repartitionById(shards, "shard").sortWithinPartitions("shard")
    links = stored(spread.mapInPandas(partial(_settle, parts, sets), "a long, b long"), "list-links")
    if links.isEmpty():
        return found
    joined = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links)
    return stored(components(joined), "list-components")


def pairs_of(listed: DataFrame, shards: int) -> DataFrame:
    """Distinct pairs (a > b) from packed lists: each class with its list's least one."""
    spread = listed.repartitionById(shards, "shard").sortWithinPartitions("shard")
    return spread.mapInPandas(_runs, "a long, b long").distinct()


def _emit_sets(wanted: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(class, set) of wanted classes, from the row that stands for the class."""
    arrays.work_for("ngram_join")
    for batch in batches:
        rows = batch["row"].to_numpy()
        for at, sets in _sets(batch):
            ids = np.array([class_of(s) for s in sets], np.int64)
            rep = arrays.lookup(*wanted, ids.view(np.uint64), "row", np.int64, -1)
            take = np.flatnonzero((rep == rows[at]) & (rep >= 0))
            if len(take):
                yield pd.DataFrame({"class": ids[take], "shingles": [sets[i].tobytes() for i in take]})


def _store_sets(folder: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[int, list[pd.DataFrame]] = {}
    for batch in batches:
        for shard, part in batch.groupby("shard"):
            held.setdefault(int(shard), []).append(part)
    for shard, parts in held.items():
        part = pd.concat(parts).drop_duplicates("class")  # a row that stands for a class may be repeated
        part = part.iloc[np.argsort(part["class"].to_numpy(np.int64).view(np.uint64))]
        sizes = part["shingles"].map(len).to_numpy() // 8
        arrays.write(folder, "key", shard, part["class"].to_numpy(np.int64).view(np.uint64))
        arrays.write(folder, "end", shard, np.cumsum(sizes))
        arrays.write(folder, "data", shard, np.frombuffer(b"".join(part["shingles"]), np.uint64))
        yield pd.DataFrame({"rows": [len(part)]})


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard similarity of the threshold or more."""
    if min(len(one), len(other)) * DEN < max(len(one), len(other)) * NUM:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both * DEN >= NUM * (len(one) + len(other) - both)


def set_reader(sets: tuple[str, int], classes: np.ndarray) -> Callable[[int], np.ndarray]:
    """Gives the set of the i-th of ``classes``, from the store."""
    folder, shards = sets
    found, shard, place = arrays.find(folder, shards, classes.view(np.uint64))
    if not found.all():
        raise ValueError("a candidate's set is missing")

    def get(i: int) -> np.ndarray:
        own, at = int(shard[i]), int(place[i])
        end = arrays.mapped(folder, "end", own, np.int64)
        return np.asarray(arrays.mapped(folder, "data", own, np.uint64))[end[at - 1] if at else 0:end[at]]

    return get


def _verify(sets: tuple[str, int], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        one, other = (set_reader(sets, batch[c].to_numpy()) for c in "ab")
        out = batch.copy()
        out["ok"] = [linked(one(i), other(i)) for i in range(len(batch))]
        yield out


def cost_boundary(sizes: dict[int, int], repeats: float) -> int:
    """X with the least estimated cost: signatures of light sets, against entries of inverted
    lists with ``repeats`` sets each."""
    def cost(x: int) -> float:
        total = 0.0
        for n, docs in sizes.items():
            p = n - overlap_needed(n) + 1
            total += docs * ((p + 1) * p / 2 if 1 < n <= x else 0) + docs * (p * (1 + repeats) if n * DEN > x * NUM else 0)
        return total
    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def join(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link if the Jaccard similarity of their sets of shingles is 3/4 or more;
    component_id is the least doc_id reachable by links, itself included. Null or empty texts
    have no shingles and link with nothing. Rows with a null id link like others but are never
    the least; if a component has no other id its component_id is null. Rows with equal sets
    (copies, repeated rows) are one class, in components with its least id. An empty table gives
    no rows; other columns are ignored. Texts are read three times, or four if a group has to be
    listed again; what is shuffled are signatures, not texts."""
    last = F.lit(2 ** 63 - 1)
    own = F.when(F.col("n") > 0, F.coalesce("least", "row")).otherwise(F.col("row"))
    return _joined(docs).select(F.when(F.col("row") < last, F.col("row")).alias("doc_id"), F.col("n").alias("n_shingles"),
                                F.when(own < last, own).alias("component_id"))


def _joined(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row (its id, a null one last), n, class, part (a class that stands
    for the component) and least (row of it); the last two null where there are no shingles."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows stand for their documents; a null id stands last
    read = read.withColumn("row", F.coalesce("doc_id", F.lit(2 ** 63 - 1)))
    texts = read.select("row", "text")
    described = stored(texts.mapInPandas(_describe, _ROWS), "join-sets")
    rows = described.where("kind = 0").select(F.col("a").alias("row"), F.col("b").alias("n"), F.col("c").alias("class"))
    shared = described.where("kind = 1").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("n"))
    common_keys = stored(shared.where(F.col("n") >= COMMON).select("key"), "join-common")
    n_common = common_keys.count()
    common = (scratch(spark, "join-common-keys"), arrays.shards_for(n_common) if n_common else 0)
    if n_common:
        arrays.store_sorted(common_keys, *common)
    classes = rows.where("n > 0").groupBy("class").agg(F.min("row").alias("row"), F.min("n").alias("n"))
    few = rows.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()  # 64 rows at most
    totals = described.agg(F.sum(F.when(F.col("kind") == 1, F.col("b"))), F.sum(F.when(F.col("kind") == 0, F.col("b")))).first()
    light = cost_boundary({r["n"]: r["count"] for r in few}, (totals[0] or 0) / max(totals[1] or 1, 1))

    shards = arrays.shards_for((totals[1] or 0) // 3, ENTRIES)  # a prefix is a quarter of a set and a little more
    listed = texts.mapInPandas(partial(_list, common, light, None, shards), arrays.LISTED)
    pairs = stored(pairs_of(listed, shards), "join-pairs")
    members = stored(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class"), "join-members")
    size = members.agg(F.count("*"), F.sum("n")).first()
    if not size[0]:
        return _answer(rows, classes, None)
    wanted = (scratch(spark, "join-wanted"), arrays.shards_for(size[0]))
    arrays.store_sorted(members.select(F.col("class").alias("key"), "row"), *wanted, {"row": np.int64})
    sets = (scratch(spark, "join-set-store"), arrays.shards_for(size[1]))
    top = F.shiftrightunsigned("class", 32)
    emitted = texts.mapInPandas(partial(_emit_sets, wanted), "class long, shingles binary").withColumn(
        "shard", F.shiftrightunsigned(top * F.lit(sets[1]).cast("long"), 32))
    with arrays.tidy(spark):
        emitted.repartitionById(sets[1], F.col("shard").cast("int")).mapInPandas(partial(_store_sets, sets[0]), "rows long").agg(F.sum("rows")).first()

    verify = partial(_verify, sets)
    checked = stored(pairs.repartition("a", "b").mapInPandas(verify, "a long, b long, ok boolean"), "join-checked")
    links = checked.where("ok").select("a", "b")
    found = stored(components(links), "join-components")
    part = F.coalesce("component", "class").alias("component")
    placed = stored(members.join(found.withColumnRenamed("id", "class"), "class", "left").select("class", "n", part), "join-placed")
    failed = checked.where("not ok").select(F.explode(F.array("a", "b")).alias("class")).distinct()
    open_parts = failed.join(placed, "class").select("component").distinct()
    again = stored(placed.join(open_parts, "component"), "join-open")
    n_open = again.count()
    if n_open:
        only = (scratch(spark, "join-open-store"), arrays.shards_for(n_open))
        arrays.store_sorted(again.select(F.col("class").alias("key")), *only)
        relisted = texts.mapInPandas(partial(_list, common, light, only, shards), arrays.LISTED)
        found = connect(relisted, shards, again.select("class", "component"), found, sets)
    return _answer(rows, classes, found)


def _answer(rows: DataFrame, classes: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows with the least id of their component. Only classes that differ from their own row
    are joined, so most rows need no partner."""
    if found is not None:
        placed = classes.join(found.withColumnRenamed("id", "class"), "class", "left").withColumn(
            "part", F.coalesce("component", "class"))
        least = placed.groupBy("part").agg(F.min("row").alias("least"))
        target = placed.where("component is not null").join(least, "part").select("class", "part", "least")
        alone = placed.where("component is null").select("class", "part", F.col("row").alias("least"))
        target = target.unionByName(alone)
    else:
        target = classes.select("class", F.col("class").alias("part"), F.col("row").alias("least"))
    known = rows.where("n > 0").join(target, "class", "left").select("row", "n", "class", "part", "least")
    nothing = F.lit(None).cast("long")
    return known.unionByName(rows.where("n = 0").select(
        "row", "n", "class", nothing.alias("part"), nothing.alias("least")))


def _row_key(rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return combine(mix(rows.astype(np.int64).view(np.uint64)), classes.astype(np.int64).view(np.uint64))


def _add_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        key = _row_key(batch["row"].to_numpy(), batch["class"].to_numpy()).view(np.int64)
        yield pd.DataFrame({"id": batch["row"], "key": key, "again": batch["again"]})


def _rows_that(again: bool, ids: tuple[str, int], told: tuple[str, int],
               batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that neither go nor are repeated; if ``again``, those that stay and are repeated."""
    for batch in batches:
        own = batch.column("doc_id").cast(pa.int64()).fill_null(2 ** 63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        value = np.full(len(own), -1, np.int64)
        some = np.flatnonzero(arrays.find(*ids, own.view(np.uint64))[0])
        if len(some):  # only their texts are looked at
            texts = batch.column("text").take(pa.array(some)).to_pylist()
            for at, sets in _sets({"text": texts}):
                n = np.array([len(s) for s in sets])
                key = _row_key(own[some[at]], np.array([class_of(s) for s in sets], np.int64))
                value[some[at]] = np.where(n > 0, arrays.lookup(*told, key, "again", np.int64, -1), -1)
        yield batch.filter(pa.array(value == (1 if again else -1)))


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column("doc_id").cast(pa.int64()).fill_null(2 ** 63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
        classes = [class_of(x) for _, sets in _sets({"text": batch.column("text").to_pylist()}) for x in sets]
        key = _row_key(own, np.array(classes, np.int64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns], ["told", *batch.schema.names])


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each group: that with the least id (a null one last),
    of several such texts the one whose set has the least digest, of its copies the one with the
    least hash of all columns. Texts without shingles stay, all rows of them. What goes is looked
    up by id and set in stores in the shared folder; only rows of a staying document that repeat
    its id and set are shuffled."""
    spark = docs.sparkSession
    groups = stored(_joined(docs), "join-groups").where("part is not null")
    each = groups.groupBy("part", "row", "class").agg(F.count("*").alias("n"))
    stays = groups.groupBy("part").agg(F.min(F.struct("row", "class")).alias("stays"))
    again = F.when(F.struct("row", "class") != F.col("stays"), 0).when(F.col("n") > 1, 1)
    told = stored(each.join(stays, "part").select("row", "class", again.cast("long").alias("again")).where(
        "again is not null").mapInPandas(_add_key, "id long, key long, again long"), "join-told")
    names = told.select(F.col("id").alias("key")).distinct()
    ids = (scratch(spark, "join-told-ids"), arrays.shards_for(n := told.count()))
    arrays.store_sorted(names, *ids)
    store = (scratch(spark, "join-told-store"), arrays.shards_for(n))
    arrays.store_sorted(told.select("key", "again"), *store, {"again": np.int64})
    kept = docs.mapInArrow(partial(_rows_that, False, ids, store), docs.schema)
    if told.where("again = 1").isEmpty():
        return kept
    text = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = docs.mapInArrow(partial(_rows_that, True, ids, store), docs.schema)
    keyed = repeated.mapInArrow(_with_key, T.StructType([T.StructField("told", T.LongType()), *docs.schema.fields]))
    one = keyed.groupBy("told").agg(F.min_by(text, F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return kept.unionByName(one)
