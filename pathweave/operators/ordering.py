"""Dense row numbers without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathweave.tables import settled


def with_seq(df: DataFrame, *order: Column | str, seq: str = "seq", partitions: int | None = None) -> DataFrame:
    """Add ``seq``, 0, 1, 2, ... in the given order.

    Rows are dealt by ranges and sorted within them; each range begins where those before it end.  Rows that
    are equal in the order are numbered as they come."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    placed = settled(ranged.withColumn("_part", F.shiftright(place, 33)).withColumn("_i", place.bitwiseAND((1 << 33) - 1)), "ranged")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    begin = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    joined = placed.join(F.broadcast(counts.select("_part", begin.alias("_begin"))), "_part")
    return joined.select(*df.columns, (F.col("_begin") + F.col("_i")).alias(seq))


def with_docid(names: DataFrame, block_size: int = 32) -> DataFrame:
    """Add ``docid``, the number of the block of ``block_size`` names in the order of ``seq``; ``pos`` in the block."""
    if block_size < 1:
        raise ValueError("a block has one name at least")
    return names.withColumn("docid", F.floor(F.col("seq") / block_size)).withColumn("pos", (F.col("seq") % block_size).cast("int"))


def ordered(df: DataFrame, limit: int | None = None, by: tuple[str, ...] = ("db_ordinal", "seq")) -> DataFrame:
    """Index order, and the first ``limit`` rows of it."""
    out = df.orderBy(*by)
    return out if limit is None else out.limit(limit)


def in_dir_order(df: DataFrame, path: str = "path") -> DataFrame:
    """The order in which a crawl lists names: all children of a directory by name, then each subdirectory's."""
    parts = F.split(F.col(path), "/")
    return df.orderBy(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1))


def sample_blocks(names: DataFrame, k: int = 1000, seed: int = 1234) -> DataFrame:
    """The names of ``k`` blocks, each with equal chance and the same in each run: those with the least hashes."""
    blocks = names.select("docid").distinct().orderBy(F.xxhash64("docid", F.lit(seed)), "docid").limit(k)
    return names.join(blocks, "docid", "left_semi").select(*names.columns)
