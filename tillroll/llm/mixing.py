"""Mixing sources to target weights.

Every source gets a target number of words; its repetition rate is target over size. A
document is emitted floor(rate) times, plus once more with the fraction as probability,
drawn from a hash of its id: it gets its further copy if the hash, a point on a circle, lies in the arc
that starts at the source's seed and is as long as the fraction. The seed is the one of ``SEEDS``
evenly spaced ones that brings the source's words nearest to its target: any seed gives every
document the same chance, but a source of few or very uneven documents can miss its target
by much with a seed taken blindly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import WORD, small, stored

WEIGHTS = (5, 2, 1)
SEED = "mix-1:"
#: Rows of the per-source table up to which it is broadcast (under 10 MB).
BROADCAST_ROWS = 50_000
SALTS = 64
#: Seeds tried per source; a power of two, so that points and arcs are compared exactly.
SEEDS = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150,
                   cap: int = 2) -> DataFrame:
    """(source, source_size) -> (source, source_size, target), targets in words.

    Sources in code point order, null last, take ``weights`` in turn and share ``percent`` % of
    all sizes. No target exceeds ``cap`` times its source; what exceeds it is shared by weight
    among the others until none is above. In order of size per weight the capped sources come
    first, so one pass over running sums finds where they end: a source is capped if the share
    left after all before it would lift it to its cap. The table has one row per source, and the
    running sums are over that table, never over documents. All sums are integers, so each target
    is one division and reruns agree. Without words every target is 0. If ``percent`` exceeds
    100 * ``cap`` all sources are capped.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    given = sizes.withColumn("w", F.element_at(
        cycle, ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = [(F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    share = given.select(
        "source", "source_size", "w",
        (F.sum("source_size").over(everything) * percent
         - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (100 * cap)).alias("left"),
        (F.sum("w").over(after) * 100).alias("over"))
    # capped: its cap is at most its share of what is left
    capped = F.col("source_size") * cap * F.col("over") <= F.col("left") * F.col("w")
    share = share.withColumn("capped", capped)
    # the first source that is not capped sets the level for all after it
    first = F.min(F.when(~F.col("capped"), F.struct(
        (F.col("source_size") / F.col("w")).alias("o"), F.col("source").isNull().alias("n"),
        F.col("source").alias("s"), "left", "over"))).over(everything)
    share = share.withColumn("first", first)
    target = F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(
        (F.col("first.left") * F.col("w")).cast("double") / F.col("first.over").cast("double"))
    return share.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(2 ** 52)


def _place(doc_id: Column, fraction: Column, seed: str) -> tuple[Column, Column]:
    """Where a document lies: in which of ``SEEDS`` parts of the circle, and whether at the part's
    beginning, which an arc that ends in that part covers."""
    at = uniform(doc_id, seed) * F.lit(float(SEEDS))
    end = fraction * F.lit(float(SEEDS))
    return F.floor(at), at - F.floor(at) < end - F.floor(end)


def _covered(part: Column, early: Column, start: Column, fraction: Column) -> Column:
    """Whether the arc from part ``start`` on covers a document."""
    whole = F.floor(fraction * F.lit(float(SEEDS)))
    after = F.pmod(part - start, F.lit(SEEDS))
    return (after < whole) | (after == whole) & early


def _rated(targets: DataFrame) -> DataFrame:
    """With ``rate`` and its ``fraction``."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.withColumn("rate", rate).withColumn("fraction", F.col("rate") - F.floor("rate"))


def _with_sources(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``rows`` (source, doc_id, ...) beside the row ``of`` their source; broadcast if ``few``, else
    salted."""
    if few:
        return rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("of")), "left")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    spread = sources.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")), "left").drop("salt", "at")


def seeded(sized: DataFrame, targets: DataFrame, few: bool, seed: str = SEED) -> DataFrame:
    """``targets`` (of, source_size, target) with rate, fraction and ``start``, the seed whose arc takes
    the words nearest to the target (ties: the first). ``sized`` has doc_id, source and size.

    Documents are summed per source and part of the circle, two rows a part at most; what an arc takes is a
    difference of running sums over the parts, laid out twice so that arcs may pass the end."""
    rated = _rated(targets)
    part, early = _place(F.col("doc_id"), F.col("fraction"), seed)
    cells = _with_sources(sized, rated, few).groupBy("of", part.alias("part")).agg(
        F.sum("size").alias("all"), F.sum(F.when(early, F.col("size")).otherwise(F.lit(0))).alias("early"))
    empty = rated.select("of", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEEDS - 1).cast("long"))).alias("part"),
                         F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("early"))
    full = cells.unionByName(empty).groupBy("of", "part").agg(F.sum("all").alias("all"), F.sum("early").alias("early"))
    twice = full.unionByName(full.withColumn("part", F.col("part") + SEEDS))
    before = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = twice.withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0)))
    starts = sums.where(F.col("part") < SEEDS).select(F.col("of").alias("own"), F.col("part").alias("start"), F.col("before").alias("first"))
    whole = F.floor(F.col("fraction") * F.lit(float(SEEDS)))
    ends = starts.join(rated, F.col("own").eqNullSafe(F.col("of"))).drop("of").withColumn("end", F.col("start") + whole)
    arcs = ends.join(sums.select("of", "part", "before", "early"), F.col("own").eqNullSafe(F.col("of")) & (F.col("end") == F.col("part")))
    taken = F.col("source_size") * F.floor("rate") + F.col("before") - F.col("first") + F.col("early")
    off = F.abs(taken.cast("double") - F.col("target"))
    best = arcs.groupBy("own").agg(F.min(F.struct(off.alias("off"), "start")).alias("best"))
    return rated.join(best, F.col("of").eqNullSafe(F.col("own")), "left").select(
        "of", "source_size", "target", "rate", "fraction", F.coalesce("best.start", F.lit(0)).alias("start"))


def _sources(docs: DataFrame, weights: Sequence[int], percent: int, cap: int, seed: str) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, source and size of each row; the stored table of sources; whether it is small)."""
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    few = small(sizes, BROADCAST_ROWS)
    targets = source_targets(sizes, weights, percent, cap).withColumnRenamed("source", "of")
    return sized, stored(seeded(sized, targets, few, seed), "mix-seeds"), few


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, cap: int = 2,
             seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text and source; other columns are ignored, whatever their names.
    Null or empty texts have size 0. Rows with one id (repeats) draw the same number. A null
    source is a source of its own, a null id draws as the text ``null``. An empty table gives
    no rows.

    Texts are read once: sizes are stored, then summed per source, and per source and part of the
    circle, with partial sums before the shuffle, so a source with a third of all rows sends few rows
    per task. The table of sources is broadcast if it has at most ``BROADCAST_ROWS`` rows; else
    documents of a source are salted over ``SALTS`` tasks and joined with as many copies of its row.
    """
    sized, sources, few = _sources(docs, weights, percent, cap, seed)
    joined = _with_sources(sized, sources, few)
    part, early = _place(F.col("doc_id"), F.col("fraction"), seed)
    once = _covered(part, early, F.col("start"), F.col("fraction")).cast("long")
    return joined.withColumn("copies", F.floor("rate") + once).select(
        "doc_id", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, cap: int = 2,
        seed: str = SEED) -> DataFrame:
    """``docs`` with each row emitted as often as ``mix_plan`` says; all columns are kept.

    The plan gives rate and seed per source, not per row, so the rows are joined with the small
    table of sources and no text is shuffled. Same results for nulls, repeats and empty tables
    as ``mix_plan``; rows of sources without words are emitted no times. Columns of ``docs``
    with the names of helper columns are safe: helpers have a prefix no input column has.
    """
    p = "_"
    while any(c.startswith(f"{p}mix") for c in docs.columns):
        p += "_"
    _, sources, few = _sources(docs, weights, percent, cap, seed)
    own = sources.select(*[F.col(c).alias(f"{p}mix_{c}") for c in ("of", "rate", "fraction", "start")])
    if few:
        joined = docs.join(F.broadcast(own), docs["source"].eqNullSafe(F.col(f"{p}mix_of")), "left")
    else:
        salted = docs.withColumn(f"{p}mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        spread = own.withColumn(f"{p}mix_at", F.explode(
            F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread, F.col("source").eqNullSafe(F.col(f"{p}mix_of"))
                             & (F.col(f"{p}mix_salt") == F.col(f"{p}mix_at")), "left")
    fraction = F.col(f"{p}mix_fraction")
    once = _covered(*_place(F.col("doc_id"), fraction, seed), F.col(f"{p}mix_start"), fraction).cast("long")
    emitted = joined.withColumn(f"{p}mix_n", (F.floor(f"{p}mix_rate") + once).cast("int")).where(F.col(f"{p}mix_n") > 0).withColumn(
        f"{p}mix_i", F.explode(F.array_repeat(F.lit(1), F.col(f"{p}mix_n"))))
    return emitted.select(*[F.col(f"`{c}`") for c in docs.columns])
