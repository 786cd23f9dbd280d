"""Near-duplicate embeddings by cross-polytope hashing.

A hash rotates a vector (three rounds of random signs and a fast Hadamard transform) and takes
the axis, with its sign, along which it is longest. A table's key is several such axes. A vector
is filed under its own key and asks for that and the next likeliest ones (multiprobe), so fewer
tables find as many neighbours. Candidates are verified by their cosine in double precision. The
number of tables is chosen so that a pair right at the threshold is missed by less than ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored
from tillroll.llm.components import components

THRESHOLD = 0.9
#: Probability of missing a pair at the threshold; keys asked for in each table; tables at most.
MISS, PROBES, MOST_TABLES = 1e-3, 6, 64
#: Members of a bucket above which it is compared by blocks instead of as pairs of ids.
DENSE = 256
SEED = 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` times the Hadamard matrix, scaled to keep lengths; width a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        y = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / math.sqrt(width)


def signs(width: int, table: int, hash_: int) -> np.ndarray:
    """Three rows of random signs, the same everywhere."""
    return np.random.default_rng([SEED, width, table, hash_]).integers(0, 2, (3, width)) * 2.0 - 1.0


def rotate(x: np.ndarray, table: int, hash_: int) -> np.ndarray:
    for s in signs(x.shape[1], table, hash_):
        x = hadamard(x * s)
    return x


def width_for(d: int) -> int:
    return 1 << max(d - 1, 0).bit_length()


def keys(x: np.ndarray, table: int, hashes: int, probes: int) -> np.ndarray:
    """(rows, probes): each row's own key first, then the likeliest others: those that change
    the axis of few hashes, by how much shorter the vector is along it."""
    n, width = len(x), x.shape[1]
    axes, loss = [], []
    for h in range(hashes):
        y = rotate(x, table, h)
        best = np.argsort(-np.abs(y), axis=1)[:, :3] if width > 2 else np.argsort(-np.abs(y), axis=1)
        length = np.take_along_axis(np.abs(y), best, 1)
        axes.append(2 * best + (np.take_along_axis(y, best, 1) < 0))
        loss.append((length[:, :1] - length) ** 2 + (length[:, :1] - length))
    depth = axes[0].shape[1]
    # all choices that change two hashes at most
    choices = [(0,) * hashes]
    choices += [tuple(r if h == i else 0 for h in range(hashes)) for i in range(hashes) for r in range(1, depth)]
    if depth > 1:
        choices += [tuple(1 if h in (i, j) else 0 for h in range(hashes)) for i in range(hashes) for j in range(i)]
    total = np.stack([sum(loss[h][:, r] for h, r in enumerate(c)) for c in choices], axis=1)
    code = np.stack([sum(axes[h][:, r].astype(np.int64) * (2 * width) ** h for h, r in enumerate(c))
                     for c in choices], axis=1)
    order = np.argsort(total, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, order, 1)


@lru_cache
def tables_needed(d: int, hashes: int, probes: int = PROBES, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Tables that find a pair right at the threshold, in either direction, but for ``miss``;
    from how often 2000 random such pairs meet in a table."""
    rng, n = np.random.default_rng(SEED), 2000
    a = rng.standard_normal((n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((n, d))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    b = threshold * a + math.sqrt(1 - threshold ** 2) * b
    x = np.zeros((2 * n, width_for(d)))
    x[:n, :d], x[n:, :d] = a, b
    met = 0
    for t in range(4):
        k = keys(x, t, hashes, probes)
        met += ((k[:n] == k[n:, :1]).any(1) | (k[n:] == k[:n, :1]).any(1)).sum()
    p = min(met / (4 * n), 0.999)
    return MOST_TABLES if p <= 0 else min(MOST_TABLES, max(1, math.ceil(math.log(miss) / math.log1p(-p))))


def hashes_needed(n: int, d: int) -> int:
    """Hashes per key so that n unrelated vectors have buckets nearly to themselves."""
    return max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * width_for(d))))


def usable(v) -> np.ndarray | None:
    """The vector in double precision; None if null, empty, zero or with a null or non-finite part."""
    if v is None:
        return None
    x = np.array([math.nan if e is None else e for e in v], np.float64)
    return x if len(x) and np.isfinite(x).all() and x.any() else None


def _digest(x: np.ndarray) -> int:
    """64 bits, signed; equal vectors are one class (0.0 and -0.0 are equal)."""
    return int.from_bytes(hashlib.blake2b((x + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True)


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [usable(v) if i == i and i is not None else None for i, v in zip(batch["vec_id"], batch["embedding"])]
        yield pd.DataFrame({
            "vec_id": batch["vec_id"].astype("Int64"), "class": pd.array([None if x is None else _digest(x) for x in rows],
                                                                        "Int64"), "vector": rows})


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lengths neither over- nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _file(tables: dict[int, tuple[int, int]], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(bucket, home, id): where a vector is filed (home) and what it asks for."""
    for batch in batches:
        for d, own in batch.groupby(batch["vector"].map(len)):
            hashes, count = tables[d]
            x = np.zeros((len(own), width_for(d)))
            x[:, :d] = _unit(own["vector"])
            ids = own["id"].to_numpy()
            for t in range(count):
                k = keys(x, t, hashes, PROBES)
                home = np.zeros(k.shape, bool)
                home[:, 0] = True
                yield pd.DataFrame({"dim": d, "tab": t, "bucket": k.ravel(), "home": home.ravel(),
                                    "id": np.repeat(ids, k.shape[1])})


def _verify(threshold: float, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = batch["va"].map(len) == batch["vb"].map(len)
        for _, own in batch[same].groupby(batch["va"].map(len)):
            near = np.einsum("ij,ij->i", _unit(own["va"]), _unit(own["vb"])) >= threshold
            yield own.loc[near, ["a", "b"]]


def _blocks(threshold: float, group: pd.DataFrame) -> pd.DataFrame:
    """Links between the two blocks of a group (or within one), as ids a < b."""
    one, two = (group[group["side"] == s] for s in (0, 1))
    two = two if len(two) else one
    if one.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    i, j = np.nonzero(_unit(one["vector"]) @ _unit(two["vector"]).T >= threshold)
    a, b = one["id"].to_numpy()[i], two["id"].to_numpy()[j]
    keep = a != b
    return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}).drop_duplicates()


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, vector) with distinct usable vectors -> links (a, b), a < b, each once.

    Buckets of up to ``DENSE`` members meet as pairs of ids; vectors are joined to distinct pairs
    only. Larger buckets are cut into blocks of at most ``DENSE``, by hash of the id, and each two
    blocks are compared in a task that hands on verified links only; so no bucket is held whole,
    and none is cut short."""
    sizes = vectors.groupBy(F.size("vector").alias("d")).count().collect()  # a row per dimension
    tables = {}
    for r in sizes:
        hashes = hashes_needed(r["count"], r["d"])
        tables[r["d"]] = hashes, tables_needed(r["d"], hashes, PROBES, threshold)
    where = ["dim", "tab", "bucket"]
    filed = stored(vectors.mapInPandas(partial(_file, tables), "dim int, tab int, bucket long, home boolean, id long"), "ann-buckets")
    count = filed.groupBy(*where).agg(F.count("*").alias("n"), F.count_if("home").alias("n_home")).where("n_home > 0 and n > 1")
    dense = stored(count.where(F.col("n") > DENSE).select(*where, "n"), "ann-dense")
    sparse = filed.join(count.where(F.col("n") <= DENSE).select(*where), where)
    home = sparse.where("home").select(*where, F.col("id").alias("a"))
    asks = sparse.select(*where, F.col("id").alias("b"))
    pairs = home.join(asks, where).where("a != b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    far = pairs.join(vectors.select(F.col("id").alias("a"), F.col("vector").alias("va")), "a").join(
        vectors.select(F.col("id").alias("b"), F.col("vector").alias("vb")), "b")
    links = far.select("a", "b", "va", "vb").mapInPandas(partial(_verify, threshold), "a long, b long")
    if dense.isEmpty():
        return links
    n = F.ceil(F.col("n") / DENSE).cast("int")
    held = filed.select(*where, "id").join(dense, where).distinct().withColumn("parts", n).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    # block i meets blocks j >= i: as side 0 of (i, j), as side 1 of (j, i)
    meet = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *where, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "id")
    compared = meet.join(vectors, "id").groupBy(*where, "i", "j").applyInPandas(
        partial(_blocks, threshold), "a long, b long")
    return links.unionByName(compared).distinct()


def find(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links hold between rows with a cosine of ``threshold`` or more and vectors of one length.
    Vectors that are null, empty, zero or hold a null or non-finite part, and rows with a null
    id, link with nothing: n_links 0, component_id their own id, kept (null ids: null, not kept).
    Equal vectors are one class: they are compared once and their links counted by its number
    of rows. Repeated rows are rows of their own. An empty table gives no rows; other columns,
    labels too, are ignored."""
    read = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = stored(read.mapInPandas(_classes, "vec_id long, class long, vector array<double>"), "ann-rows")
    classes = stored(rows.where("class is not null").groupBy(F.col("class").alias("id")).agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector")), "ann-classes")
    links = stored(near_pairs(classes.select("id", "vector"), threshold), "ann-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = classes.select(F.col("id").alias("b"), "n")
    linked = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    placed = stored(classes.select("id", "least", "n").join(linked, "id", "left").join(
        components(links), "id", "left"), "ann-placed")
    parts = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
    about = placed.join(parts, "component", "left").select(
        F.col("id").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("first", "least").alias("component_id"))
    joined = rows.select("vec_id", "class").join(about, "class", "left")
    part = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), part.alias("component_id"),
                         F.coalesce(F.col("vec_id") == part, F.lit(False)).alias("kept"))
