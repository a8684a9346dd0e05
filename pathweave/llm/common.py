"""What the operators share: word rules, row keys, bit maps of hashes, and what Python workers need."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathweave.tables import is_small, settled, ship

__all__ = ["MAP_BITS", "SPACES", "WORD", "bit_map", "columns_of", "in_arrow", "is_small", "n_words", "parted", "python_ready", "release", "row_hash", "settled", "unused"]

#: glibc's way to hand free pages back; other C libraries have none.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: The six ASCII white-space characters, and a word: a run of anything else.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bits of a map of hashes at most.
MAP_BITS = 26


#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def python_ready(spark: SparkSession) -> None:
    """What every operator with Python workers asks of a session.

    An Arrow batch has about ``BATCH_BYTES`` bytes, however many rows those are, so that long texts fit a worker's memory:
    a session with a larger bound, or none, gets this one; nothing else of it is changed.  The workers get this package
    from the driver if their own path lacks it."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def release() -> None:
    """Give free memory of this worker back: workers are kept between stages, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any names: Spark's own takes a dot in one for a field of a struct."""
    names = df.columns
    inner = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns(inner.names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, inner).toDF(*schema.names)


def columns_of(df: DataFrame, *without: str) -> list[Column]:
    """All columns of ``df`` but those named (case does not matter), whatever characters their names have."""
    gone = {w.lower() for w in without}
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c.lower() not in gone]


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until ``df`` has no column of that name (case does not matter)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Words of ``text`` as a long; 0 for null."""
    spaced = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(spaced, SPACES, "")), F.lit(0)).cast("long")


def row_hash(*columns: str) -> Column:
    """A 64-bit hash of a row's values; equal rows are equal here, and null differs from empty."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


def bit_map(chosen: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Which values of a hash column occur, as bits: a table of 64-bit words, and the number of hash bits used.

    It is made where the rows are and has at most 2 ** MAP_BITS bits (8 MB), so it may be broadcast; what it lets
    through has to be joined all the same."""
    bits = min(MAP_BITS, max(16, math.ceil(math.log2(16 * chosen.count() + 1))))
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    words = chosen.select(F.shiftright(at, 6).alias("_word"), _bit(at).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return settled(words, "bits"), bits


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))


def parted(rows: DataFrame, column: str, bit_map: tuple[DataFrame, int]) -> tuple[DataFrame, DataFrame]:
    """The rows whose hash may be among those of the map, and those whose hash is not.  No row is shuffled.

    ``rows`` has the caller's columns in a struct, if they may be named like those of the map."""
    words, bits = bit_map
    at = F.col(column).bitwiseAND((1 << bits) - 1)
    marked = rows.join(F.broadcast(words), F.shiftright(at, 6) == F.col("_word"), "left")
    maybe = F.coalesce(F.col("_bits").bitwiseAND(_bit(at)) != 0, F.lit(False))
    return marked.filter(maybe).select(*rows.columns), marked.filter(~maybe).select(*rows.columns)
