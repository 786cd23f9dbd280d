"""BPE encoding by content-defined chunks.

A rolling hash over the text's bytes cuts chunks whose ends depend on nearby content only, so
a passage that documents share falls into the same chunks in each. A chunk is encoded once per
worker and found again by its bytes. The tokenizer takes white space as a sure end of a token:
what lies between a chunk's first and last white space is encoded apart from its neighbours.
The join of two chunks is repaired by encoding again what lies around the cut, grown until both
of its ends are at white space (or an end of the text), where it agrees with the whole text.
"""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tillroll.llm.arrays import KEPT, work_for

#: Bytes of the rolling window; a cut at one position of this many; bytes of a chunk at most.
WINDOW, MEAN, MOST = 8, 256, 4096
#: Chunks, words and parts of words kept per worker (two generations of half of it each).
CHUNKS, WORDS, PARTS = 15_000, 250_000, 150_000

# Words of these characters only are split as the tokenizer's rules say; others go to it whole.
_PLAIN = re.compile("[\x21-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^a-z0-9ß-öø-ž]+")
# The same for ASCII, whose printable characters are their own byte letters.
_PLAIN_ASCII = re.compile(rb"[\x21-\x7e]+")
_SPLIT_ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers write bytes: printable ones as themselves, others from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept:
    """A mapping that holds about ``size`` entries: the older half goes when the younger is full."""

    def __init__(self, size: int) -> None:
        self.half, self.young, self.old = size // 2, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


def gear() -> np.ndarray:
    """256 odd-looking 32-bit numbers, from a fixed rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(27))).astype(np.uint32)


_GEAR = gear()


def cuts(data: bytes, window: int = WINDOW, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text. A cut comes after a byte at which the hash of the last
    ``window`` bytes is 0 modulo ``mean`` (powers of two, both) and the next byte starts a
    character; runs without one are cut every ``most`` bytes or up to 3 later."""
    n = len(data)
    if n <= window:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _GEAR[b]
    done = 1
    while done < window:  # the byte k before the last one is shifted by k: twice as many bytes a round
        h = h[done:] + (h[:-done] << np.uint32(done))
        done *= 2
    # the top bits depend on all bytes of the window
    at = np.flatnonzero(((h >> np.uint32(32 - 24)) & np.uint32(mean - 1)) == 0) + window
    at = at[at < n]
    ends = at[(b[at] & 0xC0) != 0x80].tolist()
    out, last = [], 0
    for e in [*ends, n]:
        while e - last > most:
            last += most
            while last < e and (b[last] & 0xC0) == 0x80:
                last += 1
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def joined(pieces: list[tuple[int, str, str]]) -> tuple[int, str, str]:
    """Pieces with tokens as one."""
    if len(pieces) == 1:
        return pieces[0]
    if not pieces:
        return 0, "", ""
    n, ids, tokens = zip(*pieces)
    return sum(n), " ".join(ids), " ".join(tokens)


class Encoder:
    """Encodes and decodes whole texts. ``pieces`` are (number of ids, ids as text, tokens as
    text), ids and tokens joined by one space: the tokenizer has no decoder, so decoding joins
    its tokens that way."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        # a piece for each id: many others share its texts
        self.known = {i: (1, str(i), token) for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.words, self.chunks, self.parts = Kept(WORDS), Kept(CHUNKS), Kept(PARTS)

    def _part(self, part: str | bytes) -> tuple[int, str, str]:
        found = self.parts.get(part)
        if found is None:
            tokens = self.model.tokenize(part.decode("ascii") if isinstance(part, bytes)
                                         else part.encode("utf-8").decode("latin-1").translate(self.letters))
            if len(tokens) == 1:
                found = self.known[tokens[0].id]
            else:
                known = self.known
                found = joined([known[t.id] for t in tokens])
            self.parts.put(part, found)
        return found

    def word(self, data: bytes) -> tuple[int, str, str]:
        """A stretch without white space."""
        found = self.words.get(data)
        if found is None:
            if data.isalpha():  # of ASCII letters only
                found = self._part(data.lower())
            elif _PLAIN_ASCII.fullmatch(data) and b"<|" not in data:
                found = joined([self._part(part) for part in _SPLIT_ASCII.findall(data.lower())])
            else:
                text = data.decode("utf-8")
                if _PLAIN.fullmatch(text) and "<|" not in text and unicodedata.is_normalized("NFC", text):
                    found = joined([self._part(part) for part in _SPLIT.findall(text.lower())])
                else:
                    e = self.tokenizer.encode(text, add_special_tokens=False)
                    found = len(e.ids), " ".join([str(i) for i in e.ids]), " ".join(e.tokens)
            if len(data) <= 64:
                self.words.put(data, found)
        return found

    def chunk(self, data: bytes) -> tuple[bytes, tuple[int, str, str], bytes] | None:
        """(before the first white space, what is encoded between, after the last); None if
        the chunk has no white space."""
        found = self.chunks.get(data)
        if found is None:
            words = data.split()
            head = b"" if not words or data[:1].isspace() else words[0]
            if head == data:
                return None
            tail = b"" if not words or data[-1:].isspace() else words[-1]
            inner = words[bool(head):len(words) - bool(tail)]
            known = self.words.young.get
            found = head, joined([p for w in inner if (p := known(w) or self.word(w))[0]]), tail
            self.chunks.put(data, found)
        return found

    def text(self, text: str | None) -> tuple[int, str, str]:
        data = (text or "").encode("utf-8")
        pieces: list[tuple[int, str, str]] = []
        around: list[bytes] = []  # what is left over at the last join
        start = 0
        for end in cuts(data):
            found = self.chunk(data[start:end])
            if found is None:
                around.append(data[start:end])
            else:
                head, inner, tail = found
                if around or head:
                    pieces.append(self.word(b"".join([*around, head])))
                pieces.append(inner)
                around = [tail] if tail else []
            start = end
        if around:
            pieces.append(self.word(b"".join(around)))
        return joined([p for p in pieces if p[0]])

    def texts(self, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
        """All of them. What is kept holds no cycles, so the collector would only walk through it in vain."""
        before = gc.isenabled()
        gc.disable()
        try:
            return [self.text(x) for x in texts]
        finally:
            if before:
                gc.enable()


_ENCODERS: dict[str, Encoder] = {}
KEPT["bpe"] = _ENCODERS


def encoder(path: str) -> Encoder:
    """One per worker process: what one task has encoded, the next ones find again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str, digests: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    work_for("bpe")
    e = encoder(path)
    for batch in batches:
        for at in range(0, len(batch), 1000):  # bounds what is built before it goes to Spark
            part = batch.iloc[at:at + 1000]
            done = e.texts(part["text"])
            out = {"doc_id": part["doc_id"].to_numpy(), "n_tokens": [d[0] for d in done]}
            if digests:
                for name, i in (("ids_sha256", 1), ("decoded_sha256", 2)):
                    out[name] = [hashlib.sha256(d[i].encode("utf-8")).hexdigest() for d in done]
            else:
                out |= {"ids": [np.array(d[1].split(), np.int32) for d in done], "decoded": [d[2] for d in done]}
            yield pd.DataFrame(out)


def encode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids, decoded; with
    ``digests`` the SHA-256 of the ids (decimal, joined by one space) and of the decoded text
    instead of both. Results equal the tokenizers library's for the whole text.

    ``path`` is the tokenizer's file, there on every executor. Nothing is shuffled: each worker
    keeps chunks and words of bounded number. Null texts count as empty: no tokens, empty
    decoded text. Repeated rows each keep theirs; an empty table gives no rows; other columns are
    ignored."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    real = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInPandas(
        partial(_encode, path, digests), f"doc_id {id_type}, n_tokens long, {real}")
