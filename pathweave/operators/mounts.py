"""Mount tables: which mounts show what another shows already, and which are inside an excluded one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_mounts(mounts: DataFrame) -> DataFrame:
    """The mounts that repeat part of another mount of the same device: the other's root is a prefix of theirs, as
    a string, or it is the same and the other's number is smaller."""
    a, b = mounts.alias("a"), mounts.alias("b")
    device = (F.col("a.dev_major") == F.col("b.dev_major")) & (F.col("a.dev_minor") == F.col("b.dev_minor"))
    longer = (F.length("a.root") > F.length("b.root")) & F.col("a.root").startswith(F.col("b.root"))
    later = (F.col("a.root") == F.col("b.root")) & (F.col("a.id") > F.col("b.id"))
    return a.join(b, device & (F.col("a.id") != F.col("b.id")) & (longer | later), "left_semi").select("a.*")


def pruned_mounts(mounts: DataFrame) -> DataFrame:
    """The mounts that are ``pruned`` or stand below one that is, through ``parent_id``; 0 is no parent.

    A mount table whose parents go round in a circle ends there, too."""
    return mounts.sparkSession.sql(
        """
        WITH RECURSIVE gone(id, seen) AS (
            SELECT id, array(id) FROM {mounts} WHERE pruned
            UNION ALL
            SELECT m.id, array_append(g.seen, m.id) FROM {mounts} m JOIN gone g ON m.parent_id = g.id
            WHERE m.parent_id <> 0 AND NOT m.pruned AND NOT array_contains(g.seen, m.id)
        )
        SELECT m.* FROM {mounts} m LEFT SEMI JOIN gone g ON m.id = g.id
        """,
        mounts=mounts,
    )
