"""Search: patterns and options to a DataFrame of names in index order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions.patterns import Needle, classify, match_column
from pathweave.functions.paths import basename
from pathweave.operators.index import Index
from pathweave.operators.ordering import ordered
from pathweave.operators.visibility import existing, visible
from pathweave.plans.trigrams import Groups, cut, plan

#: An index is not used where its best group leaves more than this share of all blocks.
WORTHWHILE = 0.5
#: A written index over fewer bytes of names is not used unless asked for: its jobs take longer than reading all names.
INDEX_FROM = 256 << 20
#: Up to so many candidate blocks are named to the scan of the names; beyond, they are joined.
NAMED_BLOCKS = 1000
#: Ranges of block numbers that the scan is given at most.
RANGES = 64
#: Denied directories and query trigrams beyond this number are joined by a shuffle.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Options:
    """What a search is asked: the options of the command line, as values."""

    regex: str | None = None  #: basic or extended
    ignore_case: bool = False
    basename: bool = False  #: patterns see the last path component only
    limit: int | None = None
    count: bool = False
    all: bool = True  #: accepted; names always have to match every pattern
    ignore_visibility: bool = False
    denied: DataFrame | None = field(default=None, compare=False)  #: ``dir``: directories that the caller may not list
    live: DataFrame | None = field(default=None, compare=False)  #: ``path``: names that exist now
    use_index: bool | None = None  #: None: as the statistics advise

    def __post_init__(self):
        if self.limit is not None and self.limit < 1:
            raise ValueError("a limit is at least 1")
        if self.regex not in (None, "basic", "extended"):
            raise ValueError(f"unknown kind of regular expression {self.regex!r}")


def needles_of(patterns: Sequence[str], options: Options) -> list[Needle]:
    if not patterns:
        raise ValueError("no pattern to search for")
    return [classify(p, options.regex, options.ignore_case) for p in patterns]


def predicate(needles: Sequence[Needle], path: Column, base_only: bool = False) -> Column:
    """All needles match; plain substrings are tried first."""
    hay = basename(path) if base_only else path
    cheap_first = sorted(needles, key=lambda n: n.kind != "substring")
    return reduce(lambda a, b: a & b, [match_column(n, hay) for n in cheap_first])


def scan(names: DataFrame, needles: Sequence[Needle], base_only: bool = False) -> DataFrame:
    """Read every name."""
    return names.filter(predicate(needles, F.col("path"), base_only))


def lookup(postings: DataFrame, groups: Groups) -> DataFrame:
    """The postings of all trigrams of ``groups``, each with its group's number ``gid``."""
    spark = postings.sparkSession
    rows = [(i, t) for i, g in enumerate(groups) for t in sorted(g)]
    wanted = spark.createDataFrame(rows, "gid int, trgm string")
    found = postings.filter(F.col("trgm").isin(sorted({t for _, t in rows}))) if len(rows) <= 1000 else postings
    return found.join(F.broadcast(wanted) if len(rows) <= BROADCAST_ROWS else wanted, "trgm")


def candidates(postings: DataFrame, groups: Groups) -> DataFrame:
    """The blocks that have a trigram of every group: the union within a group, the intersection of all, in one shuffle."""
    hit = lookup(postings, groups).groupBy("docid").agg(F.count_distinct("gid").alias("n"))
    return hit.filter(F.col("n") == len(groups)).select("docid")


def within(names: DataFrame, docids: Sequence[int]) -> DataFrame:
    """The names of these blocks.  The scan gets ranges that cover them, parted at the widest gaps, so that it reads the
    row groups and pages of the candidates only: the names are written in the order of their blocks."""
    at = sorted(set(docids))
    if not at:
        return names.limit(0)
    gaps = sorted(range(1, len(at)), key=lambda i: at[i - 1] - at[i])[: RANGES - 1]
    edges = [0, *sorted(i for i in gaps if at[i] - at[i - 1] > 1), len(at)]
    ranges = [F.col("docid").between(at[lo], at[hi - 1]) for lo, hi in zip(edges, edges[1:], strict=False)]
    return names.filter(reduce(lambda a, b: a | b, ranges)).filter(F.col("docid").isin(at))


def verify(names: DataFrame, blocks: DataFrame, needles: Sequence[Needle], base_only: bool = False, named: int = 0) -> DataFrame:
    """The names of the candidate blocks that do match.  Up to ``named`` blocks are looked up first and named to the scan."""
    few = [r["docid"] for r in blocks.limit(named + 1).collect()] if named else []
    if named and len(few) <= named:
        return scan(within(names, few), needles, base_only)
    return scan(names, needles, base_only).join(blocks, "docid", "left_semi").select(*names.columns)


def group_sizes(index: Index, groups: Groups) -> dict[str, int]:
    """Postings of each trigram that a query asks for: as many rows as the query has trigrams."""
    wanted = sorted({t for g in groups for t in g})
    return {r["trgm"]: r["num_docids"] for r in index.stats.filter(F.col("trgm").isin(wanted)).collect()} if wanted else {}


def find(index: Index, needles: Sequence[Needle], options: Options) -> DataFrame:
    """Matching names by the index or by a scan."""
    groups = plan(needles)
    written = index.metadata.get("n_blocks")
    small = options.use_index is None and index.metadata.get("name_bytes", INDEX_FROM) < INDEX_FROM
    if options.use_index is False or small or not groups:
        return scan(index.names, needles, options.basename)
    counts = group_sizes(index, groups)
    if any(not sum(counts.get(t, 0) for t in g) for g in groups):
        return index.names.limit(0)
    chosen = cut(groups, counts)
    if options.use_index is None:
        least = min(sum(counts.get(t, 0) for t in g) for g in chosen)
        blocks = (index.names.agg(F.max("docid")).first()[0] or 0) + 1 if written is None else written
        if least > WORTHWHILE * blocks:
            return scan(index.names, needles, options.basename)
    return verify(index.names, candidates(index.postings, chosen), needles, options.basename, 0 if written is None else NAMED_BLOCKS)


def search(indexes: Sequence[Index], patterns: Sequence[str], options: Options | None = None) -> DataFrame:
    """``db_ordinal``, ``seq``, ``path`` of all matches in index order, one index after the other, repeats kept; with
    ``count`` one row with their number.  A limit counts over all indexes together."""
    o = options or Options()
    needles = needles_of(patterns, o)
    parts = []
    for i, index in enumerate(indexes):
        found = find(index, needles, o).select(F.lit(i).alias("db_ordinal"), "seq", "path")
        if o.denied is not None and index.check_visibility and not o.ignore_visibility:
            found = visible(found, o.denied)
        parts.append(existing(found, o.live) if o.live is not None else found)
    if not parts:
        raise ValueError("no index to search")
    rows = reduce(DataFrame.unionAll, parts)
    if o.count:
        n = F.count("*")
        return rows.agg((n if o.limit is None else F.least(n, F.lit(o.limit).cast("long"))).alias("n"))
    return ordered(rows, o.limit)


def exit_status(found: DataFrame) -> int:
    """0 if there is any match, else 1."""
    return int(found.isEmpty())
