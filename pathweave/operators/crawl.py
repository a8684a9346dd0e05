"""A crawl in rounds, one for each level of directories.

A round lists the directories that the one before found, spread evenly over all tasks, and looks at the time of each
subdirectory.  A directory whose time is that of the snapshot before is not read: its children come from the
snapshot by a join.  What is excluded is not entered: directories of given names or paths, bind mounts, and file
systems of given types, which are only looked for where the device changes.

Times: the later of a directory's two change times.  It is unknown (0, 0) for one that may still change within the
clock's grain (``GUARD`` seconds), that can't be opened or that is excluded by its name or its file system: such a
directory is read again next time.  Files have (-1, 0).

A directory that can't be opened is listed and not entered; running out of file handles and a failing look at an open
directory end the crawl, unless its file system is excluded.  An entry that vanishes costs nothing but itself.
Every worker must see the same tree.
"""

from __future__ import annotations

import errno
import os
import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.mounts import bind_mounts, pruned_mounts
from pathweave.operators.prune import PruneConfig
from pathweave.functions.paths import fs_type
from pathweave.tables import settled, ship

GUARD = 3
SCHEMA = "parent string, name string, path string, is_dir boolean, sec long, nsec int, dev long, state string, raw binary"
_NAMES = ["parent", "name", "path", "is_dir", "sec", "nsec", "dev", "state", "raw"]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary()]
#: Directories for each task of a round, and rows of a batch.
DIRS_PER_TASK, ROWS = 64, 10_000
#: What stands for bytes that are no UTF-8; names with it are known by their bytes only.
ODD = "�"


class Rules:
    """What is not entered, as values that go to the workers: as many as the settings and the mount table have."""

    def __init__(self, config: PruneConfig, mounts: DataFrame | None = None):
        self.names, self.paths = frozenset(map(os.fsencode, config.names)), frozenset(map(os.fsencode, config.paths))
        self.systems = self.binds = frozenset()
        if mounts is not None and config.fs:
            closed = pruned_mounts(mounts.withColumn("pruned", fs_type(F.col("fs_type")).isin([t.upper() for t in config.fs])))
            self.systems = frozenset(os.fsencode(r["mount_point"]) for r in closed.collect())
        if mounts is not None and config.bind_mounts:
            self.binds = frozenset(os.fsencode(r["mount_point"]) for r in bind_mounts(mounts).collect())

    def look(self, path: bytes, device: int, now: float) -> tuple[int, int, int, str] | None:
        """Time, device and state of a directory; None if it has vanished.  ``device``: that of its parent."""
        if os.path.basename(path) in self.names:
            return 0, 0, device, "pruned"
        try:
            fd = os.open(path, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW)
        except FileNotFoundError:
            return None
        except OSError as e:
            if e.errno in (errno.EMFILE, errno.ENFILE):
                raise
            return 0, 0, device, "closed"
        try:
            s = os.fstat(fd)
        except OSError:
            if path in self.systems:
                return 0, 0, device, "pruned"
            raise
        finally:
            os.close(fd)
        if s.st_dev != device and path in self.systems:
            return 0, 0, s.st_dev, "pruned"
        changed = max(s.st_ctime_ns, s.st_mtime_ns)
        if changed >= (now - GUARD) * 10**9:
            changed = 0
        return changed // 10**9, changed % 10**9, s.st_dev, "pruned" if path in self.paths or path in self.binds else "open"


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def _rows(parent: bytes, device: int, children: list[tuple[bytes, bool]], rules: Rules, now: float) -> Iterator[tuple]:
    for name, is_dir in children:
        path = parent.rstrip(b"/") + b"/" + name
        found = rules.look(path, device, now) if is_dir else (-1, 0, device, "file")
        if found:
            yield _text(parent), _text(name), _text(path), is_dir, *found, path


def _listed(parent: bytes) -> list[tuple[bytes, bool]]:
    try:
        with os.scandir(parent) as it:
            return [(e.name, e.is_dir(follow_symlinks=False)) for e in it]
    except (FileNotFoundError, NotADirectoryError, PermissionError):
        return []


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], names=_NAMES)

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def crawl(spark: SparkSession, root: str, config: PruneConfig, mounts: DataFrame | None = None, before: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """All entries below ``root``: ``SCHEMA``; the root itself is none.

    ``before``: ``parent``, ``name``, ``is_dir``, ``sec``, ``nsec``, ``path`` of a snapshot that was made with the same settings."""
    ship(spark)
    rules, now = Rules(config, mounts), time.time() if now is None else now
    start = os.fsencode(root)
    frontier = spark.createDataFrame([(start, _text(start), 1, 0, os.stat(start).st_dev, 0, 0)], "raw binary, dir string, sec long, nsec int, dev long, old_sec long, old_nsec int")
    known = None
    if before is not None:
        odd = before.filter(F.contains("name", F.lit(ODD)) | F.contains("parent", F.lit(ODD))).select("parent").distinct()
        odd = settled(odd, "odd")
        known = settled(before.select("parent", "name", "is_dir").join(odd, "parent", "left_anti"), "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, dev in zip(b.column("raw").to_pylist(), b.column("dev").to_pylist(), strict=True):
                yield from _batches(_rows(raw, dev, _listed(raw), rules, now))

    def looked_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("raw", "dev", "name", "is_dir")]
            yield from _batches(row for raw, dev, name, is_dir in zip(*columns, strict=True) for row in _rows(raw, dev, [(name.encode(), is_dir)], rules, now))

    levels, n = [], 1
    while n:
        dealt = frontier.repartition(min(4 * spark.sparkContext.defaultParallelism, -(-n // DIRS_PER_TASK)), "raw")
        same = (F.col("sec") > 0) & (F.col("sec") == F.col("old_sec")) & (F.col("nsec") == F.col("old_nsec"))
        level = dealt.filter(~same).mapInArrow(read, SCHEMA)
        if known is not None:
            kept = dealt.filter(same).select("raw", "dev", "dir").join(known, F.col("dir") == F.col("parent"))
            level = level.unionByName(kept.mapInArrow(looked_at, SCHEMA))
        level = settled(level, "level")
        levels.append(level)
        frontier = level.filter("state = 'open'").select("raw", F.col("path").alias("dir"), "sec", "nsec", "dev")
        if known is not None:
            times = before.filter("is_dir and sec > 0").select(F.col("path").alias("dir"), F.col("sec").alias("old_sec"), F.col("nsec").alias("old_nsec"))
            frontier = frontier.join(times, "dir", "left").fillna({"old_sec": 0, "old_nsec": 0})
            # a directory whose children's names are no text is read, since the snapshot can't give them
            frontier = frontier.join(odd.select(F.col("parent").alias("dir"), F.lit(True).alias("odd")), "dir", "left").withColumn("old_sec", F.when(F.col("odd"), 0).otherwise(F.col("old_sec"))).drop("odd")
        else:
            frontier = frontier.withColumn("old_sec", F.lit(0).cast("long")).withColumn("old_nsec", F.lit(0))
        frontier = settled(frontier.select("raw", "dir", "sec", "nsec", "dev", "old_sec", "old_nsec"), "frontier")
        n = frontier.count()
    return reduce(DataFrame.unionByName, levels)
