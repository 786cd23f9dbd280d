import cProfile
import gc
import hashlib
import pstats
import random

import pytest

from tillroll.llm import bpe
from tillroll.llm.queries import tokenizer_path

ODD = ["", "  ", "a" * 9000, "<|endoftext|>hi <|startoftext|>x it's we'LL don't 123", "a<|endoftext|>b  \t\n c",
       "ΑΣ İstanbul ｆｕｌｌ Ŀ ŉ 한국어 ½ x\x1cy z\x85w", "漢字" * 3000, "É'S'T 's 't'RE", "x y ͅ ̈a e\u0301", "\u2028a\u00a0b",
       "no\u200bwidth", "tab\tnew\nline\r\n", "𝔘𝔫𝔦 \U0001f600\U0001f600 ok", "<|endoftext|", "x" * 5000 + " y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def test_equals_the_library(spark, library, edge, edge_rows):
    from pyspark.sql import functions as F
    rows = [(1000 + i, t) for i, t in enumerate(ODD)]
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = {i: t for i, t, *_ in edge_rows} | dict(rows)
    got = bpe.encode(df.withColumn("n_tokens", F.lit("x")), tokenizer_path()).collect()
    assert len(got) == len(edge_rows) + len(rows)
    for r in got:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        assert list(r["ids"]) == want.ids and r["n_tokens"] == len(want.ids)
        assert r["decoded"] == library.decode(want.ids, skip_special_tokens=False)


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode(docs, tokenizer_path(), digests=True).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_chunks_follow_content():
    passage = "".join(f"some words {i * 7919 % 997} of a passage é " for i in range(400)).encode()

    def chunks(data):
        ends = bpe.cuts(data)
        assert ends[-1] == len(data) and all(a < b for a, b in zip(ends, ends[1:]))
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    one, two = chunks(b"first text " * 20 + passage), chunks("ganz anderer Anfang ü ".encode() * 31 + passage + b"end")
    assert len(set(one) & set(two)) >= 0.8 * len(chunks(passage))
    for c in one:
        c.decode("utf-8")
    assert bpe.cuts(b"") == [] and max(map(len, chunks(b"a" * 50_000))) <= bpe.MOST + 3


def test_kept_is_bounded():
    kept = bpe.Kept(10)
    for i in range(100):
        kept.put(i, i)
    assert kept.get(99) == 99 and kept.get(0) is None and len(kept.young) + len(kept.old) <= 10


def test_empty_table(empty):
    assert bpe.encode(empty, tokenizer_path()).count() == 0


def test_a_worker_drops_what_other_operators_kept():
    from tillroll.llm import arrays
    arrays.work_for("bpe")
    bpe.encoder(tokenizer_path()).word(b"kept")
    arrays.work_for("bpe")
    assert bpe._ENCODERS
    arrays.work_for("ngram_join")
    assert not bpe._ENCODERS and not arrays._OPEN
    arrays.work_for("")


def test_new_words_cost_few_calls(library):
    """Every new word went through five regular expressions and rules for any script, every token through lists."""
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdefghijklmnop") for _ in range(9)) + rng.choice(["", "", "."]) for _ in range(4000)})
    one, profile = bpe.Encoder(tokenizer_path()), cProfile.Profile()
    got = profile.runcall(one.texts, [" ".join(words), None])
    calls = pstats.Stats(profile).stats
    assert not any("is_normalized" in name for _, _, name in calls)
    assert sum(n for n, *_ in calls.values()) < 30 * len(words)
    want = library.encode(" ".join(words), add_special_tokens=False)
    assert got == [(len(want.ids), " ".join(map(str, want.ids)), " ".join(want.tokens)), (0, "", "")]
    assert gc.isenabled()


def test_words_of_ascii_and_others_equal_the_library(library):
    rng = random.Random(6)
    letters = [*"aZ's09-.<|>", "'ll", "'S", "\x1c", "\x00", "\x7f", "\u00e9", "\u00df", "\u0130", "e\u0301", "\u6f22"]
    one = bpe.Encoder(tokenizer_path())
    for text in ["".join(rng.choice([*letters, " "]) for _ in range(rng.randrange(40))) for _ in range(3000)]:
        want = library.encode(text, add_special_tokens=False)
        assert one.text(text) == (len(want.ids), " ".join(map(str, want.ids)), " ".join(want.tokens)), repr(text)


def test_cuts_are_where_the_rolling_hash_says():
    data = random.Random(7).randbytes(20_000).replace(b"\x80", b" ")
    ends, mean = [], 16
    for e in range(8, len(data)):
        h = sum(int(bpe.gear()[data[e - 1 - k]]) << k for k in range(8)) & 0xFFFFFFFF
        if (h >> 8) % mean == 0 and data[e] & 0xC0 != 0x80:
            ends.append(e)
    assert bpe.cuts(data, mean=mean) == [*ends, len(data)]
