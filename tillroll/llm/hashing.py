"""Hashes of the words of whole texts, many at a time.

Each word's hash is a polynomial over its bytes (A-Z lowered), taken from one running sum over
a block of texts, then mixed. All of it is array arithmetic modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed at once, so few that the arrays of a block stay in a core's cache; a longer
#: text is a block of its own.
BLOCK = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SEP = b"\n"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of the pair; order matters."""
    return mix(left * _U(_BASE) + right)


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
_BYTES[65:91] = _BYTES[97:123]
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | (data - np.uint8(9) < 5)  # bytes below 9 wrap around


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n; kept while blocks stay small."""
    if len(_POWERS["up"]) < n:
        size = max(n, BLOCK + 4096)
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
                    for b in (_BASE, inverse))
        if size > 4 * BLOCK:  # a very long text: not kept
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, UTF-8 of some texts) of about ``BLOCK`` bytes; null counts as empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8") if isinstance(text, str) else b""
        if held and size + len(data) > BLOCK:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_hashes(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's words start; one more for the end)."""
    data = np.frombuffer(_SEP.join(held) + _SEP, np.uint8)
    space = np.ones(len(data) + 1, bool)
    space[1:] = _is_space(data)
    edge = np.flatnonzero(space[1:] != space[:-1])  # the last byte is a space
    start, end = edge[::2], edge[1::2]
    up, down = _powers(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.take(_BYTES, data, out=run[1:], mode="clip")
    run[1:] *= up[:len(data)]
    np.cumsum(run, out=run)
    hashes = mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))
    sizes = np.fromiter(map(len, held), np.int64, len(held)) + 1
    texts = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(start, texts)


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(where the words of ``text`` start, where they end) in code points."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _is_space(data)
    edge = np.flatnonzero(space[1:] != space[:-1])
    if len(data) != len(text):
        edge = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[edge]  # code points in the first bytes
    return edge[::2], edge[1::2]


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all runs of ``width`` words within a text, where each text's runs start).
    Run i of a text starts at its word i."""
    n = len(words) - width + 1
    count = np.maximum(np.diff(bounds) - width + 1, 0)
    out = np.concatenate([[0], np.cumsum(count)])
    if n <= 0:
        return np.empty(0, np.uint64), out
    run = words[:n].copy()
    for k in range(1, width):
        run = combine(run, words[k:n + k])
    keep = np.repeat(bounds[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    return run[keep], out


def shingle_sets(held: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text its set of shingles as sorted hashes; a text of fewer words is one shingle."""
    words, bounds = word_hashes(held)
    runs, at = shingle_hashes(words, bounds, width)
    out = []
    for i in range(len(held)):
        n = bounds[i + 1] - bounds[i]
        if n >= width:
            out.append(np.unique(runs[at[i]:at[i + 1]]))
        elif n:
            whole = np.full(1, n, np.uint64)
            for h in words[bounds[i]:bounds[i + 1]]:
                whole = combine(whole, np.full(1, h, np.uint64))
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out
