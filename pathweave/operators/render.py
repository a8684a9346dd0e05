"""How results are written: by line, closed by zero bytes, or quoted for a shell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions.paths import shell_quote


def rendered(found: DataFrame, quoted: bool = False) -> DataFrame:
    return found.select(*[c for c in found.columns if c != "path"], (shell_quote(F.col("path")) if quoted else F.col("path")).alias("path"))


def write_names(found: DataFrame, out: str, zero: bool = False, quoted: bool = False) -> None:
    """Text files with a name on each line, or with zero bytes for line feeds."""
    rendered(found, quoted).select("path").write.option("lineSep", "\0" if zero else "\n").text(out)
