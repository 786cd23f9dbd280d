"""Quality rules with risk-controlled thresholds.

Each signal of a document is a number in [0, 1] of which high values speak against it. Per
language and signal a cutoff is chosen from labelled rows: the lowest for which an exact
binomial test shows that less than ``ALPHA`` of the good documents lie beyond it. Cutoffs are
tested from the highest down and testing stops at the first that fails (a fixed sequence, which
needs no correction); the error level is divided among all pairs of language and signal
(Bonferroni), so with probability 1 - ``DELTA`` no cutoff in use rejects more than it may.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import map_batches, small, stored, words_of

SIGNALS = ("symbols", "dup_lines", "repeats", "upper", "punctuation", "digits", "short", "monotony")
#: Share of good documents that one signal may reject in one language, and the error level.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs are k / BINS.
BINS = 100
#: Rows of the cutoff table up to which it is broadcast (under 10 MB).
BROADCAST_ROWS = 50_000
_SYMBOLS = "#*$%&|<>"
_PUNCTUATION = "!?;:\"'()[]{}=+~^_/\\@"
_FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             + ", ".join(f"{s} double" for s in SIGNALS))


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))
    key = ids[:n].copy()
    for k in range(1, width):  # exact: windows are numbered again after each word
        key = np.unique(key * len(codes) + ids[k:n + k], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def features(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then the signals."""
    text = text or ""
    words = words_of(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    c, upper = max(chars, 1), sum(map(str.isupper, words))
    return (n, chars, symbols, dup, repeats, min(1.0, symbols / c), dup / max(len(lines), 1),
            repeats / max(n, 1), upper / max(n, 1), min(1.0, sum(map(text.count, _PUNCTUATION)) / c),
            min(1.0, sum(map(text.count, "0123456789")) / c),
            1.0 / (1.0 + n / 50.0), 1.0 - min(1.0, len(set(words)) / max(n, 1)))


def _rows(batch: pd.DataFrame) -> pd.DataFrame:
    columns = [x.split()[0] for x in _FEATURES.split(", ")]
    out = pd.DataFrame([features(x) for x in batch["text"]], columns=columns)
    out.insert(0, "doc_id", batch["doc_id"].to_numpy())
    out.insert(1, "stratum", batch["stratum"].to_numpy())
    return out


def measure(docs: DataFrame) -> DataFrame:
    """Base counts and signals of every whole text, one row per row of ``docs``."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", F.col("lang").alias("stratum"), "text")
    return map_batches(read, _rows, f"doc_id {id_type}, stratum string, {_FEATURES}").withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def log_tail(n: int, k: int, p: float) -> float:
    """log P(X <= k) for X ~ Binomial(n, p), summed downwards from k."""
    k = min(k, n)
    top = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
           + k * math.log(p) + (n - k) * math.log1p(-p))
    term, total = 1.0, 1.0
    for i in range(k, 0, -1):
        term *= i / (n - i + 1) * (1 - p) / p
        total += term
        if term < 1e-17 * total:
            break
    return min(0.0, top + math.log(total))


def choose(counts: np.ndarray, n: int, alpha: float, level: float) -> int | None:
    """counts[b]: good documents whose value lies in bin b. The lowest cutoff c (values of c or
    more are rejected) of the unbroken run of passing tests from the highest cutoff down."""
    best, beyond = None, 0
    for c in range(len(counts) - 1, 0, -1):
        beyond += int(counts[c])
        if log_tail(n, beyond, alpha) > math.log(level):
            break
        best = c
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            bins: int = BINS) -> DataFrame:
    """(stratum, signal, cutoff, n_good): the cutoffs in use, from labels (doc_id, quality).

    Only rows that pass the base rules count, as only those can be rejected by a signal. The
    table of counts has at most ``bins`` rows per language and signal however many documents
    there are; languages are tested apart, each in a task of its own over that bounded group.
    A language with too few good labelled rows gets no cutoff: no test can pass."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    good = measured.where(~F.col("base_failed")).join(known.where("quality = 1").select("doc_id"), "doc_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.least(
        F.floor(F.col(s) * bins), F.lit(bins)).cast("int").alias("bin")) for s in SIGNALS])).alias("p")
    counts = stored(good.select("stratum", pairs).groupBy("stratum", "p.signal", "p.bin").agg(
        F.count("*").alias("n")), "quality-counts")
    tests = counts.select("stratum", "signal").distinct().count()

    def test(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for signal, own in rows.groupby("signal"):
            held = np.bincount(own["bin"], weights=own["n"], minlength=bins + 1).astype(np.int64)
            n = int(held.sum())
            c = choose(held, n, alpha, delta / max(tests, 1))
            if c is not None:
                out.append((rows["stratum"].iloc[0], signal, c / bins, n))
        return pd.DataFrame(out, columns=["stratum", "signal", "cutoff", "n_good"])

    return counts.groupBy("stratum").applyInPandas(
        test, "stratum string, signal string, cutoff double, n_good long")


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): the base counts, base_failed, the
    signals, n_beyond (signals beyond their cutoff) and kept.

    Null and empty texts have no words and fail the base rules. A null language is a stratum
    of its own. Labels with null id or quality are ignored; of several for one id the lowest
    counts. Without labels there are no cutoffs and the base rules alone decide. Repeated rows
    each keep theirs; empty tables give no rows; other columns are ignored."""
    measured = stored(measure(docs), "quality-signals")
    table = stored(cutoffs(measured, labels, alpha, delta).groupBy(F.col("stratum").alias("of")).agg(
        *[F.min(F.when(F.col("signal") == s, F.col("cutoff"))).alias(f"cut_{s}") for s in SIGNALS]),
        "quality-cutoffs")
    table = F.broadcast(table) if small(table, BROADCAST_ROWS) else table
    joined = measured.join(table, F.col("stratum").eqNullSafe(F.col("of")), "left")
    beyond = sum((F.coalesce(F.floor(F.col(s) * BINS) / BINS >= F.col(f"cut_{s}"), F.lit(False)).cast("int")
                  for s in SIGNALS), F.lit(0))
    return joined.withColumn("n_beyond", beyond).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("n_beyond") == 0)).alias("kept"), "n_beyond", *SIGNALS)
