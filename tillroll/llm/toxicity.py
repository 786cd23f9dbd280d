"""Toxic passages by maximum-scoring segments.

Words (and the first letters of words, for inflected ones) get log-odds between toxic and other
labelled documents under an informative Dirichlet prior. Words beyond a z-score form the lexicon;
any other word costs a little. One linear scan per document finds all maximal-scoring segments.
A segment's score S in a text of n words has, by extreme-value theory, the expected number
K n exp(-lambda S) of as good segments in a clean text; what a document's segments have beyond
that, in nats, is summed, and a logistic curve over that sum gives the probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.arrays import work_for
from tillroll.llm.common import map_batches, remainder, stored

#: Labelled rows of each class the lexicon is fitted on at most, taken by hash of the id.
MAX_TRAIN = 20_000
#: Entries of the lexicon at most, the most significant first.
MAX_LEXICON = 50_000
#: The prior's weight as a share of all counts; the least z-score and log-odds of an entry.
PRIOR, MIN_Z, MIN_ODDS = 0.05, 2.5, 1.5
#: Cost of a word that is not in the lexicon.
DRIFT = 0.3
STEMS = (5, 4)
#: Documents whose words are counted at once.
COUNTED = 400
_TOKEN = re.compile(r"\w+")
#: A stem is kept apart from a word of the same letters.
_STEM = "^"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def _keys(words: set[str]) -> set[str]:
    found = set(words)
    for k in STEMS:
        found.update(_STEM + w[:k] for w in words if len(w) > k)
    return found


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each class that have each key, summed over some hundred documents at a time."""
    work_for("toxicity")
    for batch in batches:
        for at in range(0, len(batch), COUNTED):
            part = batch.iloc[at:at + COUNTED]
            for toxic, own in part.groupby("toxic"):
                seen = Counter()
                for text in own["text"]:
                    seen.update(_keys(set(tokens(text))))
                n = np.fromiter(seen.values(), np.int64, len(seen))
                yield pd.DataFrame({"key": list(seen), "pos": n * int(toxic), "neg": n * (1 - int(toxic))})


def training_rows(labels: DataFrame, train: Column, bound: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, toxic) of at most ``bound`` rows of each class, by hash of the id."""
    known = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("toxic") == c).orderBy(*order).limit(bound) for c in (0, 1)]
    return parts[0].unionByName(parts[1])


def lexicon(docs: DataFrame, rows: DataFrame) -> dict[str, float]:
    """Log-odds of the significant keys, from the texts of the bounded ``rows``.

    ``rows`` has at most 2 * MAX_TRAIN ids, so it is broadcast and no text is shuffled."""
    texts = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    counted = texts.select("text", "toxic").mapInPandas(_counts, "key string, pos long, neg long")
    counts = stored(counted.groupBy("key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-counts")
    total = counts.agg(F.sum("pos"), F.sum("neg")).first()
    if not total[0] or not total[1]:
        return {}
    prior = (F.col("pos") + F.col("neg")) * PRIOR
    all_prior = (total[0] + total[1]) * PRIOR
    a, b = F.col("pos") + F.col("prior"), F.col("neg") + F.col("prior")
    odds = F.log(a / (total[0] + all_prior - a)) - F.log(b / (total[1] + all_prior - b))
    scored = counts.withColumn("prior", prior).withColumn("odds", odds).withColumn(
        "z", F.col("odds") / F.sqrt(1 / a + 1 / b))
    best = scored.where((F.col("z") >= MIN_Z) & (F.col("odds") >= MIN_ODDS)).orderBy(
        F.col("z").desc(), "key").limit(MAX_LEXICON)
    return {r["key"]: r["odds"] for r in best.select("key", "odds").toLocalIterator()}


def segments(hits: list[tuple[int, float]], cost: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), given the positions and scores of the
    words above zero; each other word scores -cost. Linear in the number of hits: each one is
    appended once and merged away at most once."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, 0
    for at, score in hits:
        total -= cost * (at - last)
        start, before = at, total
        total += score
        last = at + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j -= 1
            if j < 0 or found[j][3] >= total:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, last, before, total))
    return [(s, e, b - a) for s, e, a, b in found]


def _scan(odds: dict[str, float], batch: pd.DataFrame) -> pd.DataFrame:
    known: dict[str, float] = {}

    def score(w: str) -> float:
        for k in (w, *(_STEM + w[:k] for k in STEMS if len(w) > k)):
            if k in odds:
                return odds[k]
        return 0.0

    sizes, passages = [], []
    for text in batch["text"]:
        words = tokens(text)
        for w in set(words).difference(known):
            known[w] = score(w)
        hits = [(i, known[w]) for i, w in enumerate(words) if known[w] > 0]
        if len(known) > 50_000:
            known.clear()
        sizes.append(len(words))
        passages.append([{"start": s, "end": e, "score": x} for s, e, x in segments(hits)])
    return pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": sizes, "passages": passages})


def scan(docs: DataFrame, odds: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, passages) per row; passages: all maximal-scoring segments, in tokens."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), partial(_scan, odds),
                       f"doc_id {id_type}, n_tokens long, passages array<struct<start:int,end:int,score:double>>")


def excess(k: float) -> Column:
    """What all passages have beyond the expected best of a clean text, in nats. The scores are
    log-likelihood ratios, for which lambda is 1 if the cost of other words is small."""
    floor = F.log(F.lit(k) * F.greatest(F.col("n_tokens"), F.lit(1)))
    return F.aggregate("passages", F.lit(0.0), lambda a, p: a + F.greatest(p["score"] - floor, F.lit(0.0)))


def fit_k(scanned: DataFrame, known: DataFrame, at: float) -> float:
    """K from the clean training documents: how many have a passage of score ``at`` or more,
    over how many that the formula gives for K = 1."""
    clean = scanned.join(known.where("toxic = 0").select("doc_id"), "doc_id")
    row = clean.agg(F.count_if(F.exists("passages", lambda p: p["score"] >= at)),
                    F.sum(F.col("n_tokens") * math.exp(-at))).first()
    return ((row[0] or 0) + 0.5) / max(row[1] or 0.0, 1.0)


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(-(a + b x))) for (x, n clean, n toxic), by Newton steps with a
    weak prior that keeps b finite where the classes do not overlap."""
    if not points:
        return 0.0, 0.0
    x, n0, n1 = (np.array(v, float) for v in zip(*points))
    w = np.array([math.log((n1.sum() + 1) / (n0.sum() + 1)), 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -30, 30)))
        n, r = n0 + n1, n1 - (n0 + n1) * p
        g = np.array([r.sum(), (r * x).sum()]) - 1e-2 * w
        v = n * p * (1 - p)
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


@dataclass(frozen=True)
class Fitted:
    """A lexicon, K, and the curve's two numbers."""
    odds: dict[str, float]
    k: float
    a: float
    b: float

    def score(self) -> Column:
        """From the columns of ``scan``."""
        return 1 / (1 + F.exp(-(F.lit(self.a) + F.lit(self.b) * F.least(excess(self.k), F.lit(100.0)))))

    def score_of(self, n_tokens: int, scores: list[float]) -> float:
        """The same for one text."""
        floor = math.log(self.k * max(n_tokens, 1))
        x = min(sum(max(s - floor, 0.0) for s in scores), 100.0)
        return 1 / (1 + math.exp(-(self.a + self.b * x)))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None,
        max_train: int = MAX_TRAIN) -> tuple[Fitted, DataFrame]:
    """The model, and the scan of all of ``docs`` that it was calibrated with."""
    train = F.lit(True) if train is None else train
    odds = lexicon(docs, stored(training_rows(labels, train, max_train), "toxic-rows"))
    scanned = stored(scan(docs, odds), "toxic-passages")
    known = labels.where(train & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    k = fit_k(scanned, known, min(odds.values(), default=1.0))
    bins = scanned.withColumn("excess", excess(k)).join(known, "doc_id").groupBy(
        F.least(F.round(F.col("excess") * 4) / 4, F.lit(100.0)).alias("x")).agg(
        F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).collect()  # 401 rows at most
    return Fitted(odds, k, *fit_curve([tuple(r) for r in bins])), scanned


def detect(docs: DataFrame, labels: DataFrame, train: Column | None = None, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, passages, excess, score.

    ``labels`` (doc_id, toxic) teach only where ``train`` holds (a condition on doc_id; default:
    all). The lexicon is fitted on at most ``max_train`` rows of each class; K and the curve are
    fitted on all of them, from counts in bins of the sum. Null and empty texts have no tokens
    and the score of a text without passages. Null labels and labels without a document teach
    nothing; if either class is missing, the score is the share of toxic labels (0.5 without any).
    Repeated rows each keep theirs; an empty table gives no rows; other columns are ignored."""
    model, scanned = fit(docs, labels, train, max_train)
    return scanned.withColumn("excess", excess(model.k)).withColumn("score", model.score())


def _clean(model: Fitted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    work_for("toxicity")
    for batch in batches:
        rows = _scan(model.odds, pd.DataFrame({"doc_id": 0, "text": batch.column("text").to_pylist()}))
        scores = [model.score_of(n, [p["score"] for p in found]) for n, found in zip(rows["n_tokens"], rows["passages"])]
        yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))


def clean(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """The rows of ``docs`` that are not found toxic, with all their columns. Rows are judged where
    they are read: no text is shuffled, and rows that repeat an id are judged each by its text."""
    model, _ = fit(docs, labels, train)
    return docs.mapInArrow(partial(_clean, model), docs.schema)


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 5) == 0


def is_toxic() -> Column:
    return F.col("score") >= 0.5


def passages_of(text: str, odds: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """Passages of one text, in code points; a helper to show what was found."""
    ends = [(m.start(), m.end()) for m in _TOKEN.finditer(text.lower())]
    row = _scan(odds, pd.DataFrame({"doc_id": [0], "text": [text]}))["passages"].iloc[0]
    for p in row:
        yield ends[p["start"]][0], ends[p["end"] - 1][1], p["score"]
