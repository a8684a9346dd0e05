"""Sharding by a k-d tree over metadata.

The tree begins with all rows in one node and ends with as many leaves as shards are asked for, or as the total
weight needs at ``target`` each.  A node is split at the weighted median along its widest dimension: the
values of each dimension are scaled to the table's range, and the node's width in it is its largest value less
its least.  A node for an odd number of leaves is split in proportion.  Medians come from histograms over all
rows (weights by node, dimension and bucket of the value); only the bucket with the median is cut finer, until
it holds one value.  Leaves are numbered in the tree's order and are the shards.

Rows of one group (equal texts) have equal values in every dimension and equal tie breakers, so a split does
not part them.  Where the median falls into a group so large that either side misses the node's half by more
than ``fair`` of its weight, the next widest dimension with a fair median is taken; where there is none and
even the best misses by more than ``loose``, the group itself is split by the rows' own hash, since sizes near
equal are the law.

``slot`` numbers the rows of a shard without gaps: rows are counted by shard and bucket of their hash, buckets
begin where those before them end, and only the rows of a bucket are sorted.

Cases: a null text has no bytes and weighs 1, like an empty one, and is in its group; a null key is a value of
its own; rows alike in key and text share all but the slot; ties in every dimension are broken by the group's hash; long
texts count by their bytes; an empty table gives an empty table; other columns are neither used nor returned, so that none
can clash.  Every task handles parts of nodes only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import row_hash, settled

STEP, BITS = 13, 63
#: Splits of up to so many nodes go to all tasks; a level with more nodes is joined by a shuffle.
BROADCAST_ROWS = 20_000
SALTS = 32
SLOT_ROWS = 50_000


def _with(rows: DataFrame, state: DataFrame, on: str, n: int) -> DataFrame:
    """``rows`` beside the row of ``state`` (``n`` rows) with the same ``on``; rows without one go."""
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(state), on)
    left = rows.withColumn("_salt", F.pmod(F.col("k"), F.lit(SALTS)).cast("int"))
    right = state.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "_salt"]).drop("_salt")


def cut_points(rows: DataFrame, state: DataFrame, n: int) -> DataFrame:
    """Where the running weight passes a need.

    ``rows``: ``g``, ``k`` (63 bits), ``w``.  ``state``: ``g`` and ``share`` of the group's weight; ``n`` rows.
    Result: ``g``, ``share``, ``total``, ``low``, ``high`` (least and largest k), ``at`` (the k), ``tie`` (its weight),
    ``upto`` (weight up to and with it)."""
    shift, done = BITS, []
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("under", F.lit(0).cast("long")).withColumn("total", F.lit(None).cast("long")).withColumn("low", F.lit(None).cast("long")).withColumn("high", F.lit(None).cast("long"))
    while shift > 0:
        step = min(STEP, shift)
        down = shift - step
        inside = _with(rows, state.select("g", "prefix"), "g", n).filter(F.shiftright("k", shift) == F.col("prefix"))
        buckets = inside.groupBy("g", F.shiftright("k", down).alias("bucket")).agg(F.sum("w").alias("w"), F.min("k").alias("first"), F.max("k").alias("last"))
        whole = Window.partitionBy("g")  # at most 2 ** STEP rows for each group
        summed = buckets.select("*", F.sum("w").over(whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.sum("w").over(whole).alias("all"), F.min("first").over(whole).alias("lo"), F.max("last").over(whole).alias("hi"), F.col("bucket").alias("k"))
        joined = _with(summed, state, "g", n).withColumn("total", F.coalesce("total", "all")).withColumn("low", F.coalesce("low", "lo")).withColumn("high", F.coalesce("high", "hi"))
        joined = joined.withColumn("upto", F.col("run") + F.col("under"))
        over = joined.filter(F.col("upto") >= F.col("share") * F.col("total")).groupBy("g").agg(F.min_by(F.struct("share", "total", "low", "high", "bucket", "w", "first", "last", "upto"), "bucket").alias("e"))
        edge = settled(over.select("g", "e.*"), f"edge{shift}")
        single = F.col("first") == F.col("last")
        done.append(edge.filter(single).select("g", "share", "total", "low", "high", F.col("first").alias("at"), F.col("w").alias("tie"), "upto"))
        state = edge.filter(~single).select("g", "share", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("w")).alias("under"), "total", "low", "high")
        if state.isEmpty():
            break
        shift = down
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found


def tree(rows: DataFrame, dims: int, leaves: int, fair: float = 0.005, loose: float = 0.02) -> DataFrame:
    """Add ``shard`` to ``rows``: ``u`` (row hash), ``w`` (weight), ``v`` (array of ``dims`` 63-bit values with tie breakers)."""
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    nodes = {0: leaves}  # leaves below each node that is still to be split or done; as many as there are shards
    while any(m > 1 for m in nodes.values()):
        todo = {i: m for i, m in nodes.items() if m > 1}
        spark = rows.sparkSession
        wanted = spark.createDataFrame([(i, m, (m // 2) / m) for i, m in sorted(todo.items())], "node long, m int, share double")
        state = settled(wanted.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.col("node") * dims + d)).alias("g"), "share"), "wanted")
        each = rows.select("w", F.col("node"), F.posexplode("v").alias("d", "k")).select((F.col("node") * dims + F.col("d")).alias("g"), "k", "w")
        cuts = cut_points(each, state, len(todo) * dims)
        need = F.col("share") * F.col("total")
        before = F.abs(F.col("upto") - F.col("tie") - need) < F.abs(F.col("upto") - need)
        miss = F.least(F.abs(F.col("upto") - F.col("tie") - need), F.abs(F.col("upto") - need)) / F.col("total")
        width = F.shiftright(F.col("high"), 32) - F.shiftright(F.col("low"), 32)
        rank = F.struct((F.col("miss") <= fair).cast("int").alias("fair"), F.when(F.col("miss") <= fair, F.col("width").cast("double")).otherwise(-F.col("miss")).alias("best"), (-F.col("d")).alias("d"))
        sides = cuts.select("*", F.floor(F.col("g") / dims).alias("node"), (F.col("g") % dims).cast("int").alias("d"), before.alias("before"), miss.alias("miss"), width.alias("width"))
        best = sides.groupBy("node").agg(F.max_by(F.struct("d", "at", "before", "miss", "share", "total", "upto", "tie"), rank).alias("b")).select("node", "b.*")
        best = settled(best, "cuts")
        ties = best.filter(F.col("miss") > loose)
        n_ties = ties.count()
        if n_ties:  # a group too large for either side: its rows are split by their own hashes
            inner = ties.select(F.col("node").alias("g"), "d", "at", ((F.col("share") * F.col("total") - (F.col("upto") - F.col("tie"))) / F.col("tie")).alias("share"))
            inner = settled(inner, "ties")
            own = _with(rows.select(F.col("node").alias("g"), "v", F.col("u").alias("k"), "w"), inner.select("g", "d", "at"), "g", n_ties)
            own = own.filter(F.get("v", F.col("d")) == F.col("at")).select("g", "k", "w")
            within = cut_points(own, inner.select("g", "share"), n_ties).select(F.col("g").alias("node"), F.col("at").alias("row_at"))
            best = settled(best.join(within, "node", "left"), "split")
        else:
            best = best.withColumn("row_at", F.lit(None).cast("long"))
        split = best.select("node", "d", "at", F.when(F.col("row_at").isNotNull(), False).otherwise(F.col("before")).alias("before"), "row_at")
        x = F.get("v", F.col("d"))
        left = (x < F.col("at")) | ((x == F.col("at")) & ~F.col("before") & (F.col("row_at").isNull() | (F.col("u") <= F.col("row_at"))))
        placed = rows.withColumn("k", F.col("u"))
        marked = F.broadcast(split) if len(todo) <= BROADCAST_ROWS else split
        placed = placed.join(marked, "node", "left")
        # children are numbered by their first leaf, so a node keeps its number for its first half
        half = spark.createDataFrame([(i, m // 2) for i, m in sorted(todo.items())], "node long, half long")
        placed = placed.join(F.broadcast(half) if len(todo) <= BROADCAST_ROWS else half, "node", "left")
        rows = settled(placed.withColumn("node", F.when(F.col("half").isNull() | F.coalesce(left, F.lit(True)), F.col("node")).otherwise(F.col("node") + F.col("half"))).drop("d", "at", "before", "row_at", "half", "k"), "nodes")
        nodes = {k: n for i, m in nodes.items() for k, n in ([(i, m)] if m == 1 else [(i, m // 2), (i + m // 2, m - m // 2)])}
    return rows.withColumn("shard", F.col("node").cast("int")).drop("node")


def slots(rows: DataFrame, n_rows: int, shards: int, *columns: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in each ``shard``, to ``columns``; ``u`` is the rows' hash."""
    n = max(64, math.ceil(n_rows / max(1, shards) / SLOT_ROWS))
    rows = rows.withColumn("b", F.pmod(F.col("u"), F.lit(n)))
    counts = rows.groupBy("shard", "b").agg(F.count("*").alias("n"))
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    offsets = settled(counts.select("shard", "b", begin.alias("begin")), "offsets")
    within = F.row_number().over(Window.partitionBy("shard", "b").orderBy("u", *columns)) - 1
    numbered = rows.select("shard", "b", *columns, within.alias("i"))
    joined = numbered.join(F.broadcast(offsets) if n * shards <= BROADCAST_ROWS else offsets, ["shard", "b"])
    return joined.select("shard", *columns, (F.col("begin") + F.col("i")).cast("long").alias("slot"))


def shard(df: DataFrame, dims: list[Column], weight: Column, group: Column, key: str = "doc_id", text: str = "text", shards: int | None = None, target: int | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """``key``, the columns ``extra``, ``shard`` and ``slot`` of each row.

    ``dims``: numbers that are functions of what ``group`` stands for; ``weight``: a positive long; either the
    number of ``shards`` or the ``target`` weight of one is given."""
    extra = extra or {}
    base = df.select(F.col(key).alias("_key"), weight.cast("long").alias("w"), F.shiftrightunsigned(row_hash(key, text), 1).alias("u"), F.xxhash64(group).alias("t"), *[d.cast("double").alias(f"x{i}") for i, d in enumerate(dims)], *[c.alias(f"e_{n}") for n, c in extra.items()])
    base = settled(base, "metadata")
    s = base.agg(F.count("*").alias("n"), F.sum("w").alias("w"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    if shards is None:
        shards = max(1, math.ceil((s["w"] or 0) / target))

    def scaled(i: int) -> Column:
        low, high = s[f"min{i}"], s[f"max{i}"]
        unit = (F.coalesce(F.col(f"x{i}"), F.lit(low)) - low) / (high - low) if low is not None and high > low else F.lit(0.0)
        return F.shiftleft(F.floor(unit * (2**31 - 1)).cast("long"), 32).bitwiseOR(F.shiftrightunsigned("t", 32))

    names = [f"e_{n}" for n in extra]
    rows = base.select("_key", "w", "u", F.array(*[scaled(i) for i in range(len(dims))]).alias("v"), *names)
    placed = slots(tree(rows, len(dims), shards), s["n"], shards, "_key", *names)
    return placed.select(F.col("_key").alias(key), *[F.col(f"e_{n}").alias(n) for n in extra], "shard", "slot")


def shard_documents(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """Shards of nearly equal bytes, by size, bytes for each character and bytes for each line: ``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` (null)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    size = F.octet_length(whole).cast("long") + 1
    crc = F.crc32(whole)
    n_lines = size - F.octet_length(F.replace(whole, F.lit("\n"), F.lit("")))
    dims = [F.log2(size), size / (F.length(whole) + 1), F.log2(size / n_lines)]
    found = shard(df, dims, size, whole, key, text, shards=shards, extra={"size": size, "text_crc32": crc})
    return found.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
