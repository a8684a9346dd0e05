"""The trigram index: building, reading and writing.

``names`` has ``seq``, ``docid``, ``pos``, ``path``; ``postings`` one row for each trigram and block (``trgm``, ``docid``);
``stats`` the number of blocks of each trigram; ``metadata`` one row.  A block is a unit of candidates only:
every name in a candidate block is verified.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.operators.ordering import with_docid, with_seq
from pathweave.tables import file_system

VERSION = 1
POINTER = "CURRENT"
#: Bytes of names that one task of a build has: its memory follows them, and the number of tasks the size of all names.
TASK_BYTES = 8 << 20


@dataclass
class Index:
    names: DataFrame
    postings: DataFrame
    stats: DataFrame
    metadata: dict
    tasks: int | None = None  #: of a build; None: not counted

    @property
    def check_visibility(self) -> bool:
        return bool(self.metadata["check_visibility"])


def tasks_for(names: DataFrame, path: str = "path") -> int:
    """The number of tasks that a build over these names is dealt to; reads the names once."""
    size = names.agg(F.sum(F.octet_length(path))).first()[0] or 0
    return max(1, -(-size // TASK_BYTES))


def build_trigrams(names: DataFrame, path: str = "path", docid: str = "docid", tasks: int | None = None) -> DataFrame:
    """``docid``, ``trgm``: each trigram of each block once.  Names of under three bytes have none; a trigram never
    spans two names.

    Names are dealt by their block, so that its trigrams are made distinct where they are made and only names are
    shuffled.  A task has ``TASK_BYTES`` of names or one block, whatever the number of names; ``tasks`` saves counting."""
    raw = names.select(F.col(docid).alias("docid"), F.encode(F.col(path), "UTF-8").alias("raw")).filter(F.octet_length("raw") >= 3)
    dealt = raw.repartition(tasks or tasks_for(names, path), "docid")
    placed = dealt.select("docid", "raw", F.explode(F.sequence(F.lit(1), F.octet_length("raw") - 2)).alias("i"))
    return placed.select("docid", F.expr("substring(raw, i, 3)").alias("bytes")).distinct().select("docid", F.hex("bytes").alias("trgm"))


def posting_lists(trigrams: DataFrame) -> DataFrame:
    """``trgm``, ``num_docids``, ``docids`` (ascending, each once).

    For display and for export: a row has all blocks of its trigram.  Searches read ``postings``, a row for each block."""
    lists = trigrams.groupBy("trgm").agg(F.array_sort(F.collect_list("docid")).alias("docids"))
    return lists.select("trgm", F.size("docids").cast("long").alias("num_docids"), "docids")


def posting_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("trgm").agg(F.count("*").alias("num_docids"))


def index_report(names: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: files, distinct trigrams, entries, and the mean and the largest number of entries of a trigram."""
    a = names.agg(F.count("*").alias("n_files"))
    b = stats.agg(F.count("*").alias("n_trigrams"), F.coalesce(F.sum("num_docids"), F.lit(0)).alias("n_entries"), F.avg("num_docids").alias("avg_length"), F.max("num_docids").alias("longest"))
    return a.join(F.broadcast(b))  # one row each


def build(names: DataFrame, block_size: int = 32, check_visibility: bool = True, conf_block: str = "", order: tuple[str, ...] | None = None) -> Index:
    """An index over ``path``.  Null and empty names are dropped; ``seq`` is taken over where it is dense already
    and otherwise made in the given order (the crawl's, by default)."""
    kept = names.filter(F.col("path").isNotNull() & (F.col("path") != ""))
    if "seq" not in kept.columns:
        parts = F.split("path", "/")
        key = [F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)] if order is None else list(order)
        kept = with_seq(kept, *key)
    numbered = with_docid(kept, block_size)
    tasks = tasks_for(numbered)
    postings = build_trigrams(numbered, tasks=tasks)
    return Index(numbered, postings, posting_stats(postings), {"version": VERSION, "block_size": block_size, "check_visibility": check_visibility, "conf_block": conf_block}, tasks)


def write(index: Index, path: str) -> str:
    """Write a new version of the index beside the old ones and switch to it in one rename; the version's name.

    A run that breaks off leaves the current version as it was.  The version before stays for those who still read it,
    the one before that goes.  Names are in the order of their blocks, so that a few blocks are few pages; postings are in ranges of
    trigram and block, so that one in all blocks is in no single task."""
    spark = index.names.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    base = f"{path}/{version}"
    tasks = index.tasks or tasks_for(index.names)
    index.names.repartitionByRange(tasks, "docid").sortWithinPartitions("docid", "pos").write.option("compression", "zstd").parquet(f"{base}/names")
    names = spark.read.parquet(f"{base}/names")
    postings = build_trigrams(names, tasks=tasks).repartitionByRange(tasks, "trgm", "docid").sortWithinPartitions("trgm", "docid")
    postings.write.option("compression", "zstd").parquet(f"{base}/postings")
    posting_stats(spark.read.parquet(f"{base}/postings")).repartitionByRange("trgm").sortWithinPartitions("trgm").write.parquet(f"{base}/stats")
    sizes = names.agg(F.count("*"), F.coalesce(F.max("docid") + 1, F.lit(0)), F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()
    fs, pointer = file_system(spark, f"{path}/{POINTER}")
    before = spark.read.text(f"{path}/{POINTER}").first()[0] if fs.exists(pointer) else None
    metadata = index.metadata | {"n_names": sizes[0], "n_blocks": sizes[1], "name_bytes": sizes[2], "before": before}
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.text(f"{base}/metadata")
    _, staged = file_system(spark, f"{path}/{POINTER}.{version}")
    out = fs.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    Rename = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    modes = spark.sparkContext._gateway.new_array(Rename, 1)
    modes[0] = Rename.OVERWRITE
    context.rename(staged, pointer, modes)
    oldest = json.loads(spark.read.text(f"{path}/{before}/metadata").first()[0]).get("before") if before else None
    if oldest:
        fs.delete(file_system(spark, f"{path}/{oldest}")[1], True)
    return version


def read(spark: SparkSession, path: str) -> Index:
    """The current version of an index."""
    fs, pointer = file_system(spark, f"{path}/{POINTER}")
    if not path or not fs.exists(pointer):
        raise FileNotFoundError(f"no index at {path!r}")
    version = spark.read.text(f"{path}/{POINTER}").first()[0]
    base = f"{path}/{version}"
    metadata = json.loads(spark.read.text(f"{base}/metadata").first()[0])
    if metadata["version"] > VERSION:
        raise ValueError(f"index version {metadata['version']} is newer than {VERSION}")
    return Index(spark.read.parquet(f"{base}/names"), spark.read.parquet(f"{base}/postings"), spark.read.parquet(f"{base}/stats"), metadata)


def codec_report(spark: SparkSession, path: str) -> dict[str, float]:
    """What the storage format makes of the postings: their number, bytes, bytes for each posting and for each trigram,
    and nanoseconds for each posting in a pass over all of them."""
    postings = read(spark, path).postings
    began = time.perf_counter()
    n, trigrams = postings.agg(F.count("docid"), F.count_distinct("trgm")).first()
    spent = time.perf_counter() - began
    size = section_sizes(spark, path)["postings"]
    return {"n_postings": n, "bytes": size, "bytes_per_posting": size / max(1, n), "bytes_per_trigram": size / max(1, trigrams), "ns_per_posting": spent * 1e9 / max(1, n)}


def section_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each table of the current version."""
    fs, pointer = file_system(spark, path)
    version = spark.read.text(f"{path}/{POINTER}").first()[0]
    return {s.getPath().getName(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(file_system(spark, f"{path}/{version}")[1])}
