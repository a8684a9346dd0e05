"""Mixing sources to target weights by hash thresholds.

Each document has a hash of its own, and a mix takes from a source the documents whose hashes are below a
threshold, so a larger budget takes a superset: budgets are nested.  To find the thresholds nothing is
sorted.  Sizes are summed by source and hash bucket; within each source the running sum over the buckets
names the bucket in which the budget ends; only that boundary bucket is cut into finer buckets, and so on
until it holds a single hash, which is taken if that brings the source nearer to its target.

A source's share of all words follows its weight.  Targets stop at ``max_repeats`` times the source's size,
and what that leaves is shared again by weight among the others until none is above.  A target of q sizes and
a rest takes every document q times and those below the rest's threshold once more.

Cases: a null text has no words; a null source is a source of its own, the last in order; rows alike in key
and text have one hash and are taken alike; a document without words is copied as its hash says; an empty
table gives an empty mix; long texts are counted whole; ``apply_mix`` returns all columns as they are, whatever their names,
and ``mix`` none but its own.  Reruns agree: nothing depends on the order of rows or on chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathweave.operators.ordering import with_seq

from .common import columns_of, is_small, n_words, row_hash, settled

#: Bits of the hash that one histogram resolves, and bits of the hash.
STEP, BITS = 13, 63
#: A table with a row for each source is broadcast up to so many rows; beyond, both sides are salted.
BROADCAST_ROWS = 20_000
SALTS = 32


def _hash(key: str, text: str):
    return F.shiftrightunsigned(row_hash(key, text), 1)


def _beside(rows: DataFrame, per_source: DataFrame, small: bool) -> DataFrame:
    """Each row beside its source's row; ``s`` names the source in both."""
    right = per_source.withColumnRenamed("s", "_s")
    if small:
        return rows.join(F.broadcast(right), F.col("s").eqNullSafe(F.col("_s"))).drop("_s")
    left = rows.withColumn("_salt", F.pmod(F.col("u"), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_to"))).drop("_s", "_salt", "_to")


def targets(totals: DataFrame, weights: Sequence[float], max_repeats: int, small: bool = True) -> DataFrame:
    """Add ``target`` to a table with a row for each source: ``s``, ``source_size``.

    A ``small`` number of sources is numbered in one task, others by ranges and offsets."""
    order = F.col("s").isNull(), F.col("s")
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1) if small else with_seq(totals, *order, seq="place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sized = settled(placed.select("s", "source_size", w.alias("w")), "weights")
    most, level, total = F.col("source_size") * float(max_repeats), 0.0, None
    while True:  # each turn caps at least one more source, and most often there are two or three turns
        capped = most < F.col("w") * level
        got = sized.agg(F.sum("source_size"), F.sum(F.when(capped, most)), F.sum(F.when(~capped, F.col("w")))).first()
        total = float(got[0] or 0)
        now = (total - (got[1] or 0.0)) / got[2] if got[2] else level
        if now <= level * (1 + 1e-12):
            break
        level = now
    return sized.select("s", "source_size", F.least(most, F.col("w") * level).alias("target"))


def thresholds(base: DataFrame, plan: DataFrame, small: bool) -> DataFrame:
    """For each source ``s`` of ``plan`` (``source_size``, ``target``): ``q``, the times that each document is
    taken, and ``below``, the hash below which one is taken once more.  ``base``: ``s``, ``size``, ``u``."""
    q = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = plan.withColumn("q", q).withColumn("need", F.col("target") - F.col("q") * F.col("source_size"))
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("sum_below", F.lit(0.0))
    done, shift = [], BITS
    while shift > 0:
        step = min(STEP, shift)
        low = shift - step
        inside = _beside(base, state, small).filter(F.shiftright("u", shift) == F.col("prefix"))
        buckets = inside.groupBy("s", F.shiftright("u", low).alias("bucket")).agg(F.sum("size").alias("words"), F.min("u").alias("first"), F.max("u").alias("last"))
        # at most 2 ** STEP rows for each source, whatever the rows
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        summed = _beside(buckets.withColumn("upto", upto).withColumn("u", F.col("bucket")), state, small)
        summed = summed.withColumn("upto", F.col("upto") + F.col("sum_below"))
        edge = summed.filter(F.col("upto") > F.col("need")).groupBy("s").agg(F.min_by(F.struct("bucket", "words", "first", "last", "upto", "source_size", "target", "q", "need"), "bucket").alias("e"))
        edge = settled(edge.select("s", "e.*"), f"edge{shift}")
        single = F.col("first") == F.col("last")
        nearer = F.col("need") - (F.col("upto") - F.col("words")) > F.col("words") / 2
        below = F.when(nearer, F.col("last") + 1).otherwise(F.col("first"))
        done.append(edge.filter(single).select("s", "source_size", "target", "q", below.alias("below")))
        state = edge.filter(~single).select("s", "source_size", "target", "q", "need", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("words")).alias("sum_below"))
        if state.isEmpty():
            break
        shift = low
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    # a source without a boundary has no words beyond its budget, which only a source without words has
    found = found.select(F.col("s").alias("_f"), "below")
    return plan.withColumn("q", q).join(found, F.col("s").eqNullSafe(F.col("_f")), "left").select("s", "source_size", "target", "q", F.coalesce("below", F.lit(0).cast("long")).alias("below"))


def plan_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> tuple[DataFrame, DataFrame, bool]:
    """The rows' keys, sizes and hashes, each source's plan, and whether the plan may be broadcast."""
    base = settled(df.select(F.col(key).alias("_key"), F.col(source).alias("s"), n_words(F.col(text)).alias("size"), _hash(key, text).alias("u")), "sizes")
    totals = settled(base.groupBy("s").agg(F.sum("size").alias("source_size")), "sources")
    small = is_small(totals, BROADCAST_ROWS)
    plan = settled(targets(totals, weights, max_repeats, small), "targets")
    return base, settled(thresholds(base, plan, small), "thresholds"), small


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """One row for each document: ``key``, ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), ``copies``."""
    base, plan, small = plan_mix(df, key, text, source, weights, max_repeats)
    copies = F.col("q") + (F.col("u") < F.col("below")).cast("int")
    found = _beside(base, plan, small).withColumn("copies", copies)
    return found.select(F.col("_key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def apply_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    _, plan, small = plan_mix(df, key, text, source, weights, max_repeats)
    rows = df.select(F.struct(*columns_of(df)).alias("row"), F.col(source).alias("s"), _hash(key, text).alias("u"))
    copies = F.col("q") + (F.col("u") < F.col("below")).cast("int")
    taken = _beside(rows, plan, small).select("row", copies.alias("n")).filter("n > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select("row.*")
