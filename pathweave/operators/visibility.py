"""Who may see what, and what is still there: an anti-join with closed directories, a semi-join with live names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.paths import ancestors, parent
from pathweave.tables import is_small

BROADCAST_ROWS = 100_000


def visible(names: DataFrame, denied: DataFrame, path: str = "path") -> DataFrame:
    """The names none of whose proper ancestors is in ``denied`` (``dir``), the name itself not counted.

    Ancestors are looked up once for each directory that has names, not for each name.  If the root is denied
    nothing is visible."""
    root = denied.filter(F.col("dir") == "/").limit(1)
    small = is_small(denied, BROADCAST_ROWS)
    if not root.isEmpty():
        return names.limit(0)
    where = names.withColumn("_parent", parent(F.col(path)))
    dirs = where.select("_parent").filter("_parent is not null").distinct()
    up = dirs.select("_parent", F.explode(F.array_union(ancestors(F.col("_parent")), F.array("_parent"))).alias("dir"))
    closed = up.join(F.broadcast(denied) if small else denied, "dir", "left_semi").select("_parent").distinct()
    return where.join(closed, "_parent", "left_anti").select(*names.columns)


def existing(names: DataFrame, live: DataFrame, path: str = "path") -> DataFrame:
    """The names that a fresh listing has too; links are not followed."""
    return names.join(live.select(F.col("path").alias(path)), path, "left_semi").select(*names.columns)
