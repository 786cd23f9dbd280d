"""Personal data: generated candidates, boosted trees, calibrated thresholds. Native.

Base rules find what a strict format shows. Beside them, generators of high recall propose spans
that may overlap: numbers that base rules read together with a neighbour, cards and addresses
written with other separators, local telephone numbers, mail addresses in disguise. Boosted trees
score each candidate by its format and its context. They are taught by the corpus itself: a
candidate that is also a base span is positive, one that fails its kind's check (Luhn, range,
number of digits) is negative. Per kind the lowest threshold is taken at which the share of
positives among what it accepts is ``PRECISION``; candidates beyond it that pass their check are
added to the base spans.

All columns are built-in expressions. Features take few values each, so all candidates of a
corpus are counted in at most ``CELLS`` distinct rows; only those reach the driver, which fits
the trees and turns them into a CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# The base formats; possessive, and tried only where a match can start, so no text is slow.
_MAIL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_MAIL})|\G){_MAIL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: (kind, format) of each generator; what a base rule takes as well is in here again.
GENERATORS = (
    ("email", rf"(?:(?<!{_MAIL})|\G){_MAIL}{{1,64}}+@[A-Za-z0-9-]{{1,63}}+(?:\.[A-Za-z0-9-]{{1,63}}+){{1,8}}+"),
    ("email", rf"(?<!{_MAIL}){_MAIL}{{1,64}}+\x20?[(\[{{]\x20?(?:at|AT|@)\x20?[)\]}}]\x20?[A-Za-z0-9-]{{1,63}}+"
              r"(?:\x20?(?:[(\[{]\x20?(?:dot|DOT)\x20?[)\]}]|\.)\x20?[A-Za-z0-9-]{2,63}+){1,4}+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{4}){3}(?![0-9])"),
    ("card", r"(?<![0-9])3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{12,19}+(?![0-9])"),
    ("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)
_CUES = "(?i)(?:phone|tel|call|fax|mobil|cell|card|visa|credit|mail|contact|address|host|server)"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_SPAN = "struct<txt:string,start:int,end:int,left:string,next:string>"
#: Feature -> how many values it takes.
FEATURES = {"gen": len(GENERATORS), "digits": 6, "separators": 4, "plus": 2, "paren": 2, "before": 5, "after": 5,
            "cue": 2, "same": 2}
CELLS = math.prod(FEATURES.values()) * 3
ROUNDS, RATE, PRECISION, LEAST = 20, 0.3, 0.95, 10


def _guard(kind: str, text: Column) -> Column:
    return text.contains("@") | text.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]") if kind == "email" else text.rlike("[0-9]")


def _located(df: DataFrame, text: str, name: str, kind: str, regex: str) -> DataFrame:
    """Adds ``name``: all matches with their places in code points and a little context.

    ``split`` and ``regexp_extract_all`` cut at the same matches, so the places are running sums
    of the lengths of what lies between and of the matches."""
    on, pieces, found = F.col(text), f"{name}_between", f"{name}_found"
    none = F.array().cast("array<string>")
    df = df.withColumn(found, F.when(_guard(kind, on), F.regexp_extract_all(on, F.lit(regex), F.lit(0))).otherwise(none))
    df = df.withColumn(pieces, F.when(F.size(found) > 0, F.split(on, regex, -1)).otherwise(none))
    n = F.size(found)
    around = F.zip_with(F.slice(F.col(pieces), F.lit(1), n), F.slice(F.col(pieces), F.lit(2), n),
                        lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    both = F.zip_with(F.col(found), around, lambda m, x: F.struct(
        m.alias("m"), F.length(x["a"]).alias("gap"), F.right(x["a"], F.lit(24)).alias("left"),
        F.left(x["b"], F.lit(2)).alias("next")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["all"], F.struct(
            x["m"].alias("txt"), start.alias("start"), end.alias("end"), x["left"].alias("left"),
            x["next"].alias("next"))).alias("all"))

    return df.withColumn(name, F.when(n > 0, F.aggregate(both, zero, step)["all"]).otherwise(
        F.array().cast(f"array<{_SPAN}>"))).drop(found, pieces)


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def check(kind: str, txt: Column) -> Column:
    """The check of a kind, which both base spans and candidates must pass."""
    n = F.length(_digits(txt))
    if kind == "ip":
        return txt.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(txt))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _char(c: Column) -> Column:
    """0 nothing (an end, or another match), 1 white space, 2 other, 3 letter, 4 digit."""
    return (F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 4)
            .when(c.rlike(r"^\p{L}"), 3).otherwise(2))


def _features(gen: int, c: Column) -> list[Column]:
    kind, n = GENERATORS[gen][0], F.length(_digits(c["txt"]))
    digits = F.when(n <= 8, 0).when(n <= 11, 1).when(n <= 15, 2).when(n == 16, 3).when(n <= 19, 4).otherwise(5)
    kinds = reduce(lambda a, b: a + b, [c["txt"].contains(s).cast("int") for s in (" ", "-", ".")])
    same = _digits(c["txt"]).rlike(r"^([0-9])\1*$").cast("int")
    return [F.lit(gen), digits, kinds if kind != "email" else F.lit(0), c["txt"].contains("+").cast("int"),
            c["txt"].contains("(").cast("int"), _char(F.right(c["left"], F.lit(1))), _char(F.left(c["next"], F.lit(1))),
            c["left"].rlike(_CUES).cast("int"), same]


def _place(kind: str, c: Column) -> Column:
    return F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end"))


def located(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` (array of kind rank, start, end) and ``candidates`` (features,
    kind rank, start, end, valid, known: it is a base span). Work is kept off texts without any
    digit or at sign by a look at the characters."""
    df = docs
    for k in KINDS:
        df = _located(df, text, f"pii_b_{k}", k, BASE[k])

    def base(kind: str) -> Column:
        fine = F.filter(F.col(f"pii_b_{kind}"), lambda c: check(kind, c["txt"]))
        return F.transform(fine, lambda c: _place(kind, c))

    bases = [base(k) for k in KINDS]
    df = df.withColumn("pii_base", F.concat(*bases)).drop(*[f"pii_b_{k}" for k in KINDS])
    for g, (k, regex) in enumerate(GENERATORS):
        df = _located(df, text, f"pii_g_{g}", k, regex)

    def candidate(g: int, kind: str) -> Column:
        def described(c: Column) -> Column:
            place = _place(kind, c)
            # a local number without any cue is as likely something else
            valid = check(kind, c["txt"]) & (c["left"].rlike(_CUES) if g == len(GENERATORS) - 1 else F.lit(True))
            return F.struct(place.alias("place"), valid.alias("valid"),
                            F.array_contains(F.col("pii_base"), place).alias("known"),
                            *[f.alias(n) for n, f in zip(FEATURES, _features(g, c))])
        return F.transform(F.col(f"pii_g_{g}"), described)

    candidates = [candidate(g, k) for g, (k, _) in enumerate(GENERATORS)]
    return df.withColumn("pii_candidates", F.concat(*candidates)).drop(*[f"pii_g_{g}" for g in range(len(GENERATORS))])


def cells(found: DataFrame) -> DataFrame:
    """Counts of candidates by features and label; at most ``CELLS`` rows."""
    c = found.select(F.explode("pii_candidates").alias("c")).select("c.*")
    label = F.when(F.col("known"), 1).when(~F.col("valid"), 0).otherwise(-1)
    return c.groupBy(*FEATURES, label.alias("label")).agg(F.count("*").alias("n"))


class Trees:
    """Boosted trees of depth 2 for a 0/1 label, fitted on weighted distinct rows."""

    def __init__(self, rows: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        self.trees: list[tuple] = []
        rate = (label * weight).sum() / weight.sum()
        self.start = math.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
        score = np.full(len(rows), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(rows, (label - p) * weight, p * (1 - p) * weight, 2)
            self.trees.append(tree)
            score = score + np.array([self._walk(tree, r) for r in rows])

    def _grow(self, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        def leaf(m):
            return RATE * float(np.clip(g[m].sum() / (h[m].sum() + 1.0), -4, 4))

        best = (1e-9, None)
        if depth and len(rows):
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for j, values in enumerate(FEATURES.values()):
                for t, equal in product(range(values), (False, True)):
                    m = rows[:, j] == t if equal else rows[:, j] <= t
                    if m.all() or not m.any():
                        continue
                    gain = g[m].sum() ** 2 / (h[m].sum() + 1.0) + g[~m].sum() ** 2 / (h[~m].sum() + 1.0) - whole
                    if gain > best[0]:
                        best = gain, (j, t, equal, m)
        if best[1] is None:
            return leaf(np.ones(len(rows), bool))
        j, t, equal, m = best[1]
        return (j, t, equal, self._grow(rows[m], g[m], h[m], depth - 1), self._grow(rows[~m], g[~m], h[~m], depth - 1))

    @staticmethod
    def _walk(tree, row) -> float:
        while isinstance(tree, tuple):
            j, t, equal, a, b = tree
            tree = a if (row[j] == t if equal else row[j] <= t) else b
        return tree

    def score(self, row: Sequence[int]) -> float:
        return self.start + sum(self._walk(t, row) for t in self.trees)

    def column(self, c: Column) -> Column:
        """The score as nested CASE expressions over the features of ``c``."""
        names = list(FEATURES)

        def case(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            j, t, equal, a, b = tree
            test = c[names[j]] == t if equal else c[names[j]] <= t
            return F.when(test, case(a)).otherwise(case(b))

        return reduce(lambda a, b: a + b, [case(t) for t in self.trees], F.lit(self.start))


def fit(counted: list[tuple]) -> tuple[Trees | None, dict[int, float]]:
    """Trees and the threshold of each kind, from ``cells``. A kind with fewer than ``LEAST``
    positives, or which no threshold makes precise enough, gets none and adds no spans."""
    labelled = [(list(r[:-2]), r[-2], r[-1]) for r in sorted(map(tuple, counted)) if r[-2] >= 0]
    if not any(y for _, y, _ in labelled):
        return None, {}
    rows = np.array([r for r, _, _ in labelled])
    label, weight = (np.array([x[i] for x in labelled], float) for i in (1, 2))
    trees = Trees(rows, label, weight)
    scores = np.array([trees.score(r) for r in rows])
    kind = np.array([KINDS.index(GENERATORS[r[0]][0]) for r in rows])
    limits: dict[int, float] = {}
    for k in range(len(KINDS)):
        own = kind == k
        if (label * weight)[own].sum() < LEAST:
            continue
        for t in np.unique(scores[own]):
            take = own & (scores >= t)
            if (label * weight)[take].sum() >= PRECISION * weight[take].sum():
                limits[k] = float(t)
                break
    return trees, limits


def _with_spans(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """``located`` rows with ``pii_spans``; the trees are taught by all ``candidates``."""
    trees, limits = fit(cells(candidates).collect())  # at most CELLS rows
    added = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    if trees and limits:
        def passes(c: Column) -> Column:
            limit = reduce(lambda e, k: F.when(c["place"]["kind"] == k, F.lit(limits[k])).otherwise(e),
                           limits, F.lit(float("inf")))
            apart = ~F.exists("pii_base", lambda b: (b["kind"] == c["place"]["kind"])
                              & (b["start"] < c["place"]["end"]) & (c["place"]["start"] < b["end"]))
            return c["valid"] & ~c["known"] & (trees.column(c) >= limit) & apart

        ordered = F.array_sort(F.transform(F.filter("pii_candidates", passes), lambda c: F.struct(
            c["place"]["start"].alias("start"), (-c["place"]["end"]).alias("less"), c["place"]["kind"].alias("kind"))))

        def keep(acc: Column, c: Column) -> Column:
            clash = F.exists(acc, lambda b: (b["kind"] == c["kind"]) & (c["start"] < b["end"]))
            return F.when(clash, acc).otherwise(F.array_append(acc, F.struct(
                c["start"].alias("start"), c["kind"].alias("kind"), (-c["less"]).alias("end"))))

        added = F.aggregate(ordered, added, keep)
    both = F.array_sort(F.concat(F.col("pii_base"), added))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return found.withColumn("pii_spans", F.coalesce(both, none)).withColumn(
        "pii_base", F.coalesce(F.array_sort("pii_base"), none)).drop("pii_candidates")


def written(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base spans, their digest, all spans.

    Places are code points, ends exclusive. Base spans all stay. A candidate is added if its kind
    has a threshold which its score reaches, it passes its check, and it doesn't overlap a base
    span of its kind; of added ones that overlap within a kind, the one that starts first stays,
    the longest at a tie. Null texts have no spans. Repeated rows each keep theirs; an empty
    table gives no rows; other columns are ignored. Texts are read once: their spans and
    candidates are written, and nothing is shuffled but the counts of candidates."""
    located_ = stored(located(docs.select("doc_id", "text")).drop("text"), "pii-located")
    found = _with_spans(located_, located_)

    def count(i: int) -> Column:
        return F.size(F.filter("pii_base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"),
                        written(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; other columns are as they were.
    Spans that overlap are replaced as one, named after the first. Null texts stay null; repeated
    rows and empty tables give as many rows as there are. Texts are read twice and not shuffled."""
    names = F.array(*map(F.lit, KINDS))
    given, text = docs.columns, f"c{docs.columns.index(text)}"
    found = located(docs.toDF(*[f"c{i}" for i in range(len(given))]), text)  # no name can clash
    candidates = stored(found.where(F.size("pii_candidates") > 0).select("pii_candidates"), "pii-candidates")
    found = _with_spans(found, candidates)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,k:int>>").alias("cuts"))

    def merge(acc: Column, s: Column) -> Column:
        clash = s["start"] < acc["at"]
        longer = F.greatest(acc["at"], s["end"])
        last = F.element_at(acc["cuts"], -1)
        grown = F.array_append(F.slice(acc["cuts"], F.lit(1), F.size(acc["cuts"]) - 1),
                               F.struct(last["a"].alias("a"), longer.alias("b"), last["k"].alias("k")))
        fresh = F.array_append(acc["cuts"], F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k")))
        return F.struct(longer.alias("at"), F.when(clash, grown).otherwise(fresh).alias("cuts"))

    merged = F.aggregate("pii_spans", zero, merge)["cuts"]
    found = found.withColumn("pii_cuts", F.when(F.size("pii_spans") > 0, merged))
    on = F.col(text)
    end = F.struct(F.length(on).alias("a"), F.length(on).alias("b"), F.lit(-1).alias("k"))
    cuts = F.concat(F.col("pii_cuts"), F.array(end))
    begins = F.concat(F.array(F.lit(0)), F.transform("pii_cuts", lambda c: c["b"]))
    pieces = F.zip_with(begins, cuts, lambda b, c: F.concat(F.substr(on, b + 1, c["a"] - b), F.when(
        c["k"] >= 0, F.concat(F.lit("["), F.element_at(names, F.greatest(c["k"], F.lit(0)) + 1), F.lit("]"))).otherwise("")))
    clean = F.when(F.size("pii_spans") > 0, F.array_join(pieces, "")).otherwise(on)
    return found.withColumn(text, clean).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(given)])
