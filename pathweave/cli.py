"""Command line: ``python -m pathweave.cli search | build | update``.

``search`` prints names; ``build`` makes an index of a text file of names or of a binary path database;
``update`` lists a tree, prunes it and indexes it, reusing what the index before says about unchanged
directories.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.patterns import PatternError
from pathweave.functions.paths import ancestors, shell_quote
from pathweave.operators import index as I
from pathweave.operators.crawl import crawl
from pathweave.operators.merge import usable
from pathweave.operators.ordering import ordered
from pathweave.operators.prune import PruneConfig
from pathweave.operators.search import Options, exit_status, search
from pathweave.operators.visibility import existing, visible
from pathweave.sources import config, files
from pathweave.tables import settled, ship


def _session() -> SparkSession:
    return SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pathweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="print the names that match all patterns")
    s.add_argument("patterns", nargs="+")
    s.add_argument("-A", "--all", action="store_true", help="names must match all patterns (they always must)")
    s.add_argument("-b", "--basename", action="store_true")
    s.add_argument("-w", "--wholename", dest="basename", action="store_false")
    s.add_argument("-c", "--count", action="store_true")
    s.add_argument("-d", "--database", action="append", default=[], help="index paths, separated by colons")
    s.add_argument("-e", "--existing", action="store_true")
    s.add_argument("-i", "--ignore-case", action="store_true")
    s.add_argument("-l", "-n", "--limit", type=int)
    s.add_argument("-N", "--literal", action="store_true", help="never quote names")
    s.add_argument("-0", "--null", action="store_true")
    s.add_argument("-r", "--regexp", dest="regex", action="store_const", const="basic")
    s.add_argument("--regex", dest="regex", action="store_const", const="extended")
    s.add_argument("--ignore-visibility", action="store_true")
    b = sub.add_parser("build", help="index a file of names")
    b.add_argument("source")
    b.add_argument("index")
    b.add_argument("-b", "--block-size", type=int, default=32)
    b.add_argument("-p", "--plaintext", action="store_true")
    b.add_argument("-l", "--require-visibility", default="yes")
    u = sub.add_parser("update", help="index a tree of directories")
    u.add_argument("-U", "--database-root", default="/")
    u.add_argument("-o", "--output", required=True)
    u.add_argument("-b", "--block-size", type=int, default=32)
    u.add_argument("-f", "--add-prunefs", action="append", default=[])
    u.add_argument("-n", "--add-prunenames", action="append", default=[])
    u.add_argument("-e", "--add-prunepaths", action="append", default=[])
    u.add_argument("--add-single-prunepath", action="append", default=[])
    u.add_argument("--prunefs")
    u.add_argument("--prunenames")
    u.add_argument("--prunepaths")
    u.add_argument("--prune-bind-mounts")
    u.add_argument("--config", default="/etc/pathweave.conf")
    u.add_argument("--mounts", default="/proc/self/mountinfo")
    u.add_argument("-l", "--require-visibility", default="yes")
    u.add_argument("-v", "--verbose", action="store_true", help="print names as they are indexed")
    u.add_argument("--debug-pruning", action="store_true", help="print the settings and what they leave out")
    return p


def _where(rows: DataFrame, test: Callable[[str], bool]) -> DataFrame:
    """The rows of one string column for which ``test`` holds, looked at where the rows are, once for each value."""
    ship(rows.sparkSession)
    (column,) = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([test(x) for x in b.column(0).to_pylist()], pa.bool_()))

    return rows.distinct().mapInArrow(run, f"{column} string")


def _closed(names: DataFrame) -> DataFrame:
    """The directories of the names that this account may not list and enter."""
    dirs = names.select(F.explode(F.array_union(ancestors(F.col("path")), F.array(F.lit("/")))).alias("dir"))
    return _where(dirs, lambda x: os.path.isdir(x) and not os.access(x, os.R_OK | os.X_OK))


def _live(names: DataFrame) -> DataFrame:
    return _where(names.select("path"), os.path.lexists)


def run_search(spark: SparkSession, a: argparse.Namespace, out=None) -> int:
    out = out or sys.stdout
    paths = files.index_paths(a.database, os.environ.get("PATHWEAVE_PATH"))
    indexes = [I.read(spark, p) for p in paths]
    o = {"regex": a.regex, "ignore_case": a.ignore_case, "basename": a.basename, "ignore_visibility": a.ignore_visibility}
    found = settled(search(indexes, a.patterns, Options(**o)), "matches")  # text matches first; files are looked at after
    guarded = [] if a.ignore_visibility else [i for i, x in enumerate(indexes) if x.check_visibility]
    if guarded:
        checked = F.col("db_ordinal").isin(guarded)
        seen = found.filter(checked)
        found = visible(seen, settled(_closed(seen), "closed")).unionByName(found.filter(~checked))
    full = ordered(existing(found, settled(_live(found), "live")) if a.existing else found, a.limit)
    if a.count:
        n = full.count()
        print(n, file=out)
        return int(n == 0)
    if out.isatty() and not a.literal and not a.null:
        full = full.withColumn("path", shell_quote(F.col("path")))
    for row in full.toLocalIterator():
        out.write(row["path"] + ("\0" if a.null else "\n"))
    return exit_status(full)


def run_build(spark: SparkSession, a: argparse.Namespace) -> int:
    names = files.text_names(spark, a.source) if a.plaintext else files.path_database(spark, a.source)
    I.write(I.build(names.select("seq", "path"), a.block_size, config.parse_flag(a.require_visibility)), a.index)
    return 0


def _settings(a: argparse.Namespace) -> PruneConfig:
    lists = {k: v for k, v in (("fs", a.prunefs), ("names", a.prunenames), ("paths", a.prunepaths)) if v is not None}
    added = {"fs": a.add_prunefs, "names": a.add_prunenames, "paths": a.add_prunepaths}
    return config.override(config.load(a.config), lists, added, a.add_single_prunepath, a.prune_bind_mounts)


def run_update(spark: SparkSession, a: argparse.Namespace) -> int:
    c = _settings(a)
    root = config.canonical(a.database_root)
    mounts = None
    if (c.fs or c.bind_mounts) and os.path.exists(a.mounts):
        with open(a.mounts, encoding="utf-8") as f:
            mounts = files.mount_info(spark.createDataFrame([(x.rstrip("\n"),) for x in f], "value string"))
    try:
        before = I.read(spark, a.output)
    except FileNotFoundError:
        before = None
    reused = before is not None and usable(before.metadata, c, I.VERSION) and "sec" in before.names.columns
    entries = crawl(spark, root, c, mounts, before.names if reused else None)
    if a.debug_pruning:
        print(c.block(), file=sys.stderr)
        for r in entries.filter("state = 'pruned'").select("path").toLocalIterator():
            print(f"not entered: {r['path']}", file=sys.stderr)
    rows = entries.filter("path <> '/'").select("path", "parent", "name", "is_dir", "sec", "nsec")
    built = I.build(rows, a.block_size, config.parse_flag(a.require_visibility), c.block())
    if a.verbose:
        for r in built.names.orderBy("seq").toLocalIterator():
            print(r["path"])
    I.write(built, config.canonical(a.output))
    closed = entries.filter("state = 'closed'").count()
    if closed:
        print(f"{closed} directories could not be read", file=sys.stderr)
    return 0


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return {"search": run_search, "build": run_build, "update": run_update}[a.command](_session(), a)
    except (PatternError, ValueError, FileNotFoundError) as e:
        print(f"pathweave: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
