"""A live listing of directories as a Spark data source: one partition for each subtree of the root."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathweave.tables import ship

SCHEMA = "parent string, name string, path string, is_dir boolean, sec long, nsec int, dev long, readable boolean"


def _entry(parent: str, e: os.DirEntry) -> tuple:
    is_dir = e.is_dir(follow_symlinks=False)
    s = e.stat(follow_symlinks=False)
    t = max(s.st_ctime_ns, s.st_mtime_ns) if is_dir else -(10**9)
    path = parent.rstrip("/") + "/" + e.name
    return parent, e.name, path, is_dir, t // 10**9, t % 10**9, s.st_dev, not is_dir or os.access(path, os.R_OK | os.X_OK)


def _entries(parent: str) -> list[tuple]:
    """A directory's entries by name; one that vanishes meanwhile is left out alone."""
    found = []
    with os.scandir(parent) as it:
        for e in it:
            try:
                found.append(_entry(parent, e))
            except FileNotFoundError:
                continue
    return sorted(found, key=lambda x: x[1].encode("utf-8", "surrogateescape"))


def _clean(row: tuple) -> tuple:
    return tuple(x.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if isinstance(x, str) else x for x in row)


def walk(top: str, closed: frozenset[str], names: frozenset[str]) -> Iterator[tuple]:
    """All entries below ``top``: a directory's children by name, then the contents of its subdirectories.  What is
    pruned or can't be read is listed and not entered."""
    stack = [top]
    while stack:
        here = stack.pop()
        try:
            found = _entries(here)
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            continue
        yield from map(_clean, found)
        stack += [r[2] for r in reversed(found) if r[3] and r[2] not in closed and r[1] not in names]


class _Subtree(InputPartition):
    def __init__(self, top: str, alone: bool):
        super().__init__(top)
        self.top, self.alone = top, alone


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["root"]
        self.closed = frozenset(x for x in options.get("prunepaths", "").split("\0") if x)
        self.names = frozenset(x for x in options.get("prunenames", "").split("\0") if x)

    def partitions(self) -> Sequence[InputPartition]:
        with os.scandir(self.root) as it:
            tops = sorted(e.path for e in it if e.is_dir(follow_symlinks=False) and e.path not in self.closed and e.name not in self.names)
        return [_Subtree(self.root, True), *[_Subtree(t, False) for t in tops]]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        if not partition.alone:
            return walk(partition.top, self.closed, self.names)
        return map(_clean, _entries(self.root))


class ListingSource(DataSource):
    """``spark.read.format("listing").option("root", "/srv").load()``; every worker must see the same tree."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def listing(spark: SparkSession, root: str, prunepaths: Sequence[str] = (), prunenames: Sequence[str] = ()) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ListingSource)
    found = spark.read.format("listing").option("root", os.path.realpath(root))
    return found.option("prunepaths", "\0".join(prunepaths)).option("prunenames", "\0".join(prunenames)).load()


def denied_dirs(entries: DataFrame) -> DataFrame:
    """The directories of a listing that its reader may not list and enter."""
    return entries.filter("is_dir and not readable").selectExpr("path as dir")
