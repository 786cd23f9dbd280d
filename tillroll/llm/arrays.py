"""Arrays in the shared folder, written by tasks and memory-mapped by workers.

A store is a folder of flat binary files named ``<name>-<shard>.bin``. A task writes a file under a
name of its own and renames it, so repeated or lost tasks do no harm. A shared folder that is
mounted (a ``file:`` path) is mapped in place; of any other store a worker maps a local copy
whose name it removes at once.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go when the job is done, not when the driver collects garbage:
    for jobs whose result is stored. Only plans made here are concerned."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _filesystem(folder: str):
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def write_file(folder: str, name: str, data: bytes) -> str:
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def write(folder: str, name: str, shard: int, array: np.ndarray) -> None:
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    own = f"{path}/.{name}-{shard}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as out:
        out.write(np.ascontiguousarray(array).view(np.uint8).data if len(array) else b"")
    files.move(own, f"{path}/{name}-{shard}.bin")


def read(folder: str, name: str, shard: int, dtype) -> np.ndarray:
    """The array, mapped; empty if no task wrote it."""
    files, path = _filesystem(folder)
    info = files.get_file_info(f"{path}/{name}-{shard}.bin")
    if not info.is_file or not info.size:
        return np.empty(0, dtype)
    if files.type_name == "local":
        return np.memmap(info.path, dtype, "r")
    with tempfile.NamedTemporaryFile(dir=os.environ.get("TMPDIR")) as own:
        with files.open_input_stream(info.path) as stream:
            while block := stream.read(1 << 24):
                own.write(block)
        own.flush()
        return np.memmap(own.name, dtype, "r")


_OPEN: dict[tuple, np.ndarray] = {}
#: What operators keep in a worker from task to task, by operator, and the one that works now.
KEPT: dict[str, dict] = {"arrays": _OPEN}
_NOW: list[str] = [""]


def work_for(operator: str) -> None:
    """Told by a task's function first: what other operators kept in this worker goes."""
    if _NOW[0] != operator:
        for name, held in KEPT.items():
            if name != operator:
                held.clear()
        gc.collect()
        _NOW[0] = operator


def mapped(folder: str, name: str, shard: int, dtype) -> np.ndarray:
    """``read``, kept open by the worker while it works for the same store."""
    key = (folder, name, shard)
    if key not in _OPEN:
        if len(_OPEN) > 4096:
            _OPEN.clear()
        _OPEN[key] = read(folder, name, shard, dtype)
    return _OPEN[key]


def shards_for(rows: int, each: int = 1_000_000) -> int:
    """How many shards keep ``rows`` evenly spread rows near ``each`` a shard."""
    return max(1, -(-rows // each))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the top 32 bits of unsigned 64-bit keys, so shards are ranges of keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def store_sorted(df: DataFrame, folder: str, shards: int, values: dict[str, type] | None = None) -> list[int]:
    """Writes ``df`` (key: long, read as unsigned, distinct; then value columns) as sorted arrays
    ``key`` and one per value, a shard by a task. Returns the number of rows of each shard."""
    values = values or {}

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        for batch in batches:
            for shard, part in batch.groupby("shard"):
                held.setdefault(int(shard), []).append(part)
        for shard, parts in held.items():
            part = pd.concat(parts)
            keys = part["key"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(keys)
            write(folder, "key", shard, keys[order])
            for name, kind in values.items():
                write(folder, name, shard, part[name].to_numpy().astype(kind)[order])
            yield pd.DataFrame({"shard": [shard], "rows": [len(keys)]})

    # the shard as shard_of() has it: unsigned top 32 bits times shards, top again
    top = F.shiftrightunsigned("key", 32)
    placed = df.withColumn("shard", F.shiftrightunsigned(top * F.lit(shards).cast("long"), 32))
    with tidy(df.sparkSession):
        done = placed.repartition(shards, "shard").mapInPandas(put, "shard int, rows long").collect()
    counts = {r["shard"]: r["rows"] for r in done}
    return [counts.get(s, 0) for s in range(shards)]


def find(folder: str, shards: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, shard, position) of unsigned ``keys`` in a store; positions hold where found."""
    found, place = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    shard = shard_of(keys, shards)
    order = np.argsort(keys)  # sorted queries read the mapped pages once, in order
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)).tolist():  # those that hold any
        own = order[edges[s]:edges[s + 1]]
        held = mapped(folder, "key", s, np.uint64)
        if len(held):
            at = np.searchsorted(held, keys[own])
            at[at == len(held)] = 0
            found[own] = held[at] == keys[own]
            place[own] = at
    return found, shard, place


def values(folder: str, shards: int, name: str, dtype, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The values at places that ``find`` gave as found."""
    out = np.empty(len(place), dtype)
    for s in np.unique(shard).tolist():
        own = shard == s
        out[own] = mapped(folder, name, s, dtype)[place[own]]
    return out


def lookup(folder: str, shards: int, keys: np.ndarray, name: str, dtype, missing) -> np.ndarray:
    """The value of each key, ``missing`` where there is none."""
    found, shard, place = find(folder, shards, keys)
    out = np.full(len(keys), missing, dtype)
    out[found] = values(folder, shards, name, dtype, shard[found], place[found])
    return out


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as gaps, byte by byte of all of them: equal bytes come together, so
    the shuffle's compression removes what the keys have in common."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    return gaps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64)


def by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list]]:
    """(shard, its rows) of a partition sorted by shard."""
    now, rows = None, []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if now is not None and row.shard != now:
                yield now, rows
                rows = []
            now = row.shard
            rows.append(row)
    if now is not None:
        yield now, rows


LISTED = "shard int, kind int, keys binary, at binary, classes binary, more binary"


def packed_lists(keys: np.ndarray, classes: np.ndarray, shards: int) -> Iterator[pd.DataFrame]:
    """Entries (key, class) in order of the key, a row per shard: packed keys, the distinct classes
    and for each key the place of its class."""
    shard = shard_of(keys, shards)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if b > a:
            own, at = np.unique(classes[a:b], return_inverse=True)
            place = at.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
            yield pd.DataFrame({"shard": [s], "kind": [0], "keys": [pack(keys[a:b])], "at": [place], "classes": [own.tobytes()],
                                "more": [b""]})


def packed_pairs(kind: int, shard: int, one: np.ndarray, other: np.ndarray, more: np.ndarray | None = None) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "kind": [kind], "keys": [one.tobytes()], "at": [b""], "classes": [other.tobytes()],
                         "more": [b"" if more is None else more.tobytes()]})


def unpacked_list(row) -> tuple[np.ndarray, np.ndarray]:
    """(keys, class of each) of a row of ``packed_lists``."""
    at = np.ascontiguousarray(np.frombuffer(row.at, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return unpack(row.keys), np.frombuffer(row.classes, np.int64)[at]
