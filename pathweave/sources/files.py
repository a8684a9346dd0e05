"""Names from files: plain text, binary path databases, mount tables, and lists of index paths."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions.paths import octal_unescape
from pathweave.operators.ordering import with_seq
from pathweave.tables import ship

#: Fixed value of the format: the first eight bytes of a binary path database.
MAGIC = b"\0mlocate"


def text_names(spark: SparkSession, path: str) -> DataFrame:
    """``seq``, ``path``: one name for each line, in the order of the files and of their lines.  The last line feed
    may be absent, empty lines are dropped, and a line may have any length."""
    rows = spark.read.text(path, lineSep="\n").select(F.col("value").alias("path"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    rows = rows.withColumn("_line", F.monotonically_increasing_id()).filter("path <> ''")
    return with_seq(rows, "_file", "_block", "_line").select("seq", "path")


def parse_path_database(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The names of a binary path database, each with whether it is a directory.

    Header: magic, length of the settings (big-endian), version, visibility, two bytes; then the root, closed by a
    zero; the settings; then a record for each directory: time (16 bytes), path, entries (type and name), 2."""
    if data[:8] != MAGIC:
        raise ValueError("this is no path database")

    def string(at: int) -> tuple[bytes, int]:
        end = data.find(b"\0", at)
        if end < 0:
            raise IndexError
        return data[at:end], end + 1

    at = 0
    try:
        (settings,) = struct.unpack_from(">I", data, 8)
        _, at = string(16)
        at += settings
        while at < len(data):
            directory, at = string(at + 16)
            base = b"" if directory == b"/" else directory
            while data[at] in (0, 1):
                is_dir = data[at] == 1
                name, at = string(at + 1)
                yield base + b"/" + name, is_dir
            if data[at] != 2:
                raise ValueError(f"unknown kind of entry {data[at]} in the path database, at byte {at}")
            at += 1
    except (IndexError, struct.error):
        raise ValueError(f"the path database breaks off after byte {at}") from None


def path_database(spark: SparkSession, path: str) -> DataFrame:
    """``seq``, ``path``, ``is_dir``, ``path_bytes`` of the databases at ``path``, in their own order.

    A database is one stream without an index, so each file is one task's; its names leave it in batches."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                held: list[tuple] = []
                for n, (name, is_dir) in enumerate(parse_path_database(content)):
                    held.append((file, n, name.decode("utf-8", "replace"), is_dir, name))
                    if len(held) == 10_000:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_file", "_n", "path", "is_dir", "path_bytes"])

    names = files.mapInArrow(run, "_file string, _n long, path string, is_dir boolean, path_bytes binary")
    return with_seq(names, "_file", "_n").select("seq", "path", "is_dir", "path_bytes")


def _mount_fields(line: Column) -> list[Column]:
    head = F.split(F.substring_index(line, " - ", 1), " ")
    tail = F.split(F.substring_index(line, " - ", -1), " ")
    device = F.split(F.get(head, F.lit(2)), ":")
    return [
        F.get(head, F.lit(0)).cast("int").alias("id"),
        F.get(head, F.lit(1)).cast("int").alias("parent_id"),
        F.get(device, F.lit(0)).cast("int").alias("dev_major"),
        F.get(device, F.lit(1)).cast("int").alias("dev_minor"),
        octal_unescape(F.get(head, F.lit(3))).alias("root"),
        octal_unescape(F.get(head, F.lit(4))).alias("mount_point"),
        octal_unescape(F.get(tail, F.lit(0))).alias("fs_type"),
        octal_unescape(F.get(tail, F.lit(1))).alias("source"),
    ]


def mount_info(rows: DataFrame, line: str = "value") -> DataFrame:
    """Lines of a mountinfo table as columns; optional fields before the lone dash are skipped."""
    return rows.filter(F.instr(F.col(line), " - ") > 0).select(*_mount_fields(F.col(line)))


def mounts_at(rows: DataFrame, directory: str, line: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """The first line of a mount table (device, directory, type, ...) for ``directory``."""
    parts = F.split(F.col(line), " ")
    named = rows.select(F.col(ordinal).alias("ordinal"), octal_unescape(F.get(parts, F.lit(1))).alias("mount_point"), F.get(parts, F.lit(2)).alias("fs_type"))
    return named.filter(F.col("mount_point") == directory).orderBy("ordinal").limit(1)


def split_index_paths(text: str) -> list[str]:
    """Index paths separated by colons; a backslash takes the next character as it is."""
    out, current, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if i + 1 == len(text):
                raise ValueError("the list of indexes ends in a backslash")
            current += text[i + 1]
            i += 1
        elif c == ":":
            out.append(current)
            current = ""
        else:
            current += c
        i += 1
    out.append(current)
    if not all(out):
        raise ValueError(f"an index path in {text!r} is empty")
    return out


def index_paths(named: list[str], environment: str | None = None, default: str | None = None) -> list[str]:
    """All indexes to search: those named, or the default one, and those of the environment."""
    found = [p for text in named for p in split_index_paths(text)] or ([default] if default else [])
    return found + (split_index_paths(environment) if environment else [])
