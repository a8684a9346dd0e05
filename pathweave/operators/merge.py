"""Re-indexing: directories whose time has not changed give their children from the snapshot before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.paths import join_path
from pathweave.operators.prune import PruneConfig


def unchanged(dirs: DataFrame, before: DataFrame) -> DataFrame:
    """The directories of ``dirs`` (``dir``, ``sec``, ``nsec``) with the same known time in ``before``."""
    same = before.filter("sec > 0").select("dir", "sec", "nsec")
    return dirs.join(same, ["dir", "sec", "nsec"], "left_semi").select("dir")


def usable(metadata: dict | None, config: PruneConfig, version: int) -> bool:
    """Whether a snapshot may be reused: it is of this version and was pruned in the same way."""
    return bool(metadata) and metadata.get("version") == version and metadata.get("conf_block") == config.block()


def with_old_times(entries: DataFrame, before: DataFrame) -> DataFrame:
    """Each entry (``parent``, ``name``) with the time that it had before; (0, 0), unknown, for a new one."""
    old = before.select("parent", "name", F.col("sec").alias("old_sec"), F.col("nsec").alias("old_nsec"))
    zero = {"old_sec": 0, "old_nsec": 0}
    return entries.join(old, ["parent", "name"], "left").fillna(zero)


def merge_snapshot(before: DataFrame, dirs: DataFrame, dirs_before: DataFrame, listing: DataFrame) -> DataFrame:
    """``parent``, ``name``, ``is_dir``, ``path``: children of unchanged directories from ``before``, all others from
    ``listing``.  Directories that ``dirs`` lacks are gone with all their entries."""
    same = unchanged(dirs, dirs_before)
    parent = F.col("parent") == F.col("dir")
    kept = before.join(same, parent, "left_semi").select("parent", "name", "is_dir")
    changed = dirs.select("dir").join(same, "dir", "left_anti")
    fresh = listing.join(changed, parent, "left_semi").select("parent", "name", "is_dir")
    return kept.unionAll(fresh).withColumn("path", join_path(F.col("parent"), F.col("name")))
