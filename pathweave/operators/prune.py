"""Pruning: the contents of excluded directories go, the directories themselves stay listed."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.paths import ancestors, fs_type, parent
from pathweave.operators.mounts import bind_mounts, pruned_mounts


@dataclass(frozen=True)
class PruneConfig:
    bind_mounts: bool = False
    fs: Sequence[str] = ()
    names: Sequence[str] = ()
    paths: Sequence[str] = ()

    def block(self) -> str:
        """The settings in one form: two runs prune alike if and only if these strings are equal."""
        lists = {"prunefs": {x.upper() for x in self.fs}, "prunenames": set(self.names), "prunepaths": set(self.paths)}
        return json.dumps({"prune_bind_mounts": self.bind_mounts} | {k: sorted(v, key=str.encode) for k, v in lists.items()}, sort_keys=True)


def _without(listing: DataFrame, closed: DataFrame, path: str) -> DataFrame:
    """``listing`` without what lies below the directories ``closed`` (``dir``)."""
    where = listing.withColumn("_parent", parent(F.col(path)))
    dirs = where.select("_parent").filter("_parent is not null").distinct()
    up = dirs.select("_parent", F.explode(F.array_union(ancestors(F.col("_parent")), F.array("_parent"))).alias("dir"))
    below = up.join(closed, "dir", "left_semi").select("_parent").distinct()
    return where.join(below, "_parent", "left_anti").select(*listing.columns)


def prune_paths(listing: DataFrame, paths: Sequence[str], path: str = "path") -> DataFrame:
    """Exact directories; one inside another needs no mention."""
    if not paths:
        return listing
    return _without(listing, listing.sparkSession.createDataFrame([(p,) for p in sorted(set(paths))], "dir string"), path)


def prune_names(listing: DataFrame, names: Sequence[str], path: str = "path") -> DataFrame:
    """Directories of exactly these names, wherever they are."""
    if not names:
        return listing
    dirs = F.slice(F.split(F.col(path), "/"), 1, F.greatest(F.size(F.split(F.col(path), "/")) - 1, F.lit(0)))
    return listing.filter(~F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in sorted(set(names))])))


def prune_fs(listing: DataFrame, mounts: DataFrame, types: Sequence[str], path: str = "path") -> DataFrame:
    """What is below mount points of these file systems, and below mounts inside them; case does not matter."""
    closed = pruned_mounts(mounts.withColumn("pruned", fs_type(F.col("fs_type")).isin([t.upper() for t in types])))
    return _without(listing, closed.select(F.col("mount_point").alias("dir")), path)


def prune_bind_mounts(listing: DataFrame, mounts: DataFrame, path: str = "path") -> DataFrame:
    return _without(listing, bind_mounts(mounts).select(F.col("mount_point").alias("dir")), path)


def prune(listing: DataFrame, config: PruneConfig, mounts: DataFrame | None = None, path: str = "path") -> DataFrame:
    """All rules of ``config``.  The root itself is never listed."""
    out = prune_names(prune_paths(listing.filter(F.col(path) != "/"), config.paths, path), config.names, path)
    if mounts is not None and config.fs:
        out = prune_fs(out, mounts, config.fs, path)
    return prune_bind_mounts(out, mounts, path) if mounts is not None and config.bind_mounts else out
