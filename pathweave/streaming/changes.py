"""Streams: standing searches over arriving names, and snapshots that follow a stream of directory listings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.operators.search import Options, needles_of, predicate


def standing_search(names: DataFrame, patterns: Sequence[str], options: Options | None = None) -> DataFrame:
    """The matching rows of a stream with a ``path`` column; the same predicate as a search, row by row."""
    o = options or Options()
    return names.filter(predicate(needles_of(patterns, o), F.col("path"), o.basename))


def latest(changes: DataFrame) -> DataFrame:
    """The last listing of each directory in a batch (``dir``, ``sec``, ``nsec``, ``entries``)."""
    newest = F.max_by(F.struct("sec", "nsec", "entries"), F.struct("sec", "nsec"))
    return changes.groupBy("dir").agg(newest.alias("x")).select("dir", "x.*")


def apply_changes(before: DataFrame, changes: DataFrame) -> DataFrame:
    """A snapshot (``dir``, ``sec``, ``nsec``, ``entries``) in which the directories of ``changes`` are replaced by listings that are
    as new or newer; a directory that was listed too soon after its change has time 0 and is always replaced."""
    both = before.select("dir", "sec", "nsec", "entries", F.lit(0).alias("new")).unionByName(latest(changes).withColumn("new", F.lit(1)))
    order = F.struct("sec", "nsec", "new")
    return both.groupBy("dir").agg(F.max_by(F.struct("sec", "nsec", "entries"), order).alias("x")).select("dir", "x.*")


def follow(changes: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that keeps a snapshot current: ``load`` reads it, ``save`` writes its next version under the
    batch's number, so that a repeated batch writes the same version again."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            save(apply_changes(load(), batch), number)

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
