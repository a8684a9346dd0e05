"""Tables in the folder that driver and executors share; they end a lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and all runs on this machine, a local folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pathweave-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for ``path``, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which ``clear`` removes."""
    path = f"{shared_dir(spark)}/pathweave-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return f"{path}/{name}"


@atexit.register
def clear() -> None:
    """Remove all tables that were settled so far: when the results that read them are written.

    A session that goes on for long calls this between its queries; otherwise it happens when the interpreter ends."""
    while _made:
        spark, path = _made.pop()
        try:
            if spark.sparkContext._jsc is not None:
                fs, where = file_system(spark, path)
                fs.delete(where, True)
        except Exception:  # noqa: BLE001  the session is over; the folder's owner clears it
            pass


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    An executor that goes takes nothing of it along, and a later pass reads only the columns that it needs.
    The tables go with ``clear``."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than it must."""
    return df.limit(rows + 1).count() <= rows


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once for each application: their own path may lack it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="pathweave-")) / "pathweave-workers.zip"
    with zipfile.ZipFile(place, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(place))
    _shipped.add(context.applicationId)
