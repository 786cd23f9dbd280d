import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tillroll.llm import byte_bpe
from tillroll.llm.queries import BYTE_RANKS, op13_byte_bpe

from .conftest import SF

PATH = str(public_tokenizers.path(BYTE_RANKS))
ODD = [None, "", " ", "a" * 9000, "x" * 200_000, " \t\n\x1c\x1d x\x85y  　​ z", "漢字" * 3000, "it's we'LL 123456 ½ Ⅷ",
       "é" * 5000 + "ab" * 3000, " " * 5000 + "x", "\n" * 3000, "𝔘𝔫𝔦 \U0001f600\U0001f600 ok", "<|endoftext|>", "'s'S 'tt́"]


def odd_texts():
    rng = random.Random(1)
    return [*ODD, "".join(chr(rng.randrange(0x20, 0x3000)) for _ in range(20_000)), "".join(rng.choice("theins") for _ in range(3000)),
            *["".join(rng.choice("thaeionrsüß 19'") for _ in range(rng.randrange(200))) for _ in range(300)]]


@pytest.fixture(scope="module")
def library():
    import tiktoken
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.encoder(PATH, public_tokenizers.PATTERN)


def collect(encoder, texts):
    out = [([], b"") for _ in texts]
    for k, ids, data in encoder.texts(texts):
        out[k] = out[k][0] + ids.tolist(), out[k][1] + data.tobytes()
    return out


@pytest.mark.parametrize("long,pieces,cells", [(1024, 400_000, 1 << 20), (4, 400_000, 1 << 20), (1024, 1000, 64)])
def test_equals_the_library(encoder, library, monkeypatch, long, pieces, cells):
    """Also with rows of their own from 5 bytes on, and with texts in many parts."""
    for name, value in (("LONG", long), ("PIECES", pieces), ("CELLS", cells)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = odd_texts()
    for text, (ids, data) in zip(texts, collect(encoder, texts)):
        assert ids == library.encode_ordinary(text or "")
        assert data == (text or "").encode("utf-8")


def test_ranks_that_are_not_in_the_order_of_merges(tmp_path):
    """A merge may make a pair of a lower rank, which then goes before what is further right."""
    import tiktoken
    tokens = [bytes([b]) for b in range(256)] + [b"xab", b"aba", b"ab", b"bxab", b"abab", b"xx", b"xxx"]
    path = str(tmp_path / "order.tiktoken")
    with open(path, "wb") as out:
        for i, t in enumerate(tokens):
            out.write(base64.b64encode(t) + b" " + str(i).encode() + b"\n")
    own = byte_bpe.Encoder(path, r"\S+|\s+")
    lib = tiktoken.Encoding("order", pat_str=r"\S+|\s+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abx") for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    for t in texts:
        row = own._row(own.byte[np.frombuffer(t.encode(), np.uint8)])
        assert row.tolist() == lib.encode_ordinary(t)
    assert [ids for ids, _ in collect(own, texts)] == [lib.encode_ordinary(t) for t in texts]


def test_pairs_find_every_pair_and_no_other():
    rng = np.random.default_rng(3)
    keys = rng.permutation(250_000)[:20_000]
    pairs = byte_bpe.Pairs(keys // 500, keys % 500, np.arange(len(keys)))
    every = np.arange(250_000)
    want = np.full(250_000, byte_bpe.NONE)
    want[keys] = np.arange(len(keys))
    assert (pairs(every // 500, every % 500) == want).all()
    assert (pairs(np.array([-1, 3]), np.array([2, -1])) == byte_bpe.NONE).all()


def test_edge_rows(spark, edge, edge_rows, empty, library):
    got = byte_bpe.encode(edge, PATH, public_tokenizers.PATTERN).collect()
    texts = {i: t for i, t, *_ in edge_rows}
    assert len(got) == len(edge_rows)
    for r in got:
        assert list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]] or "") and r["n_tokens"] == len(r["ids"])
        assert r["decoded"] == (texts[r["doc_id"]] or "")
    assert byte_bpe.encode(empty, PATH, public_tokenizers.PATTERN, digests=True).count() == 0
    big = spark.createDataFrame([((1 << 62) + 1, "a"), (None, "b")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in byte_bpe.encode(big, PATH, public_tokenizers.PATTERN).collect()} == {(1 << 62) + 1, None}


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_byte_bpe(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_files_of_other_ranks_are_refused(tmp_path):
    path = tmp_path / "holes"
    path.write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        byte_bpe.Encoder(str(path), public_tokenizers.PATTERN)
