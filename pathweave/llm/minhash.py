"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures, confirmed on full sets.

A document's set has its distinct shingles of five words, ASCII letters lower-cased; one with fewer words has
the whole sequence as its only shingle.  Documents with equal sets are one class, found by a hash of the set.
Classes get a signature of ``POSITIONS`` MinHashes: 8 bits of the first ``CHUNKS * WIDTH``, and 4 bits of all.

Index.  The 8-bit positions are cut into ``CHUNKS`` chunks.  Two signatures that differ in at
most 2 * CHUNKS - 1 of them differ in at most one position of some chunk (pigeonhole), and then agree in one
of the keys that leave out one position of a chunk.  Each class enters all its keys, so every pair up to that
distance meets in a bucket.  At a Jaccard similarity of 0.85, 9 of 60 positions differ in the mean and 20 or
more in about 2 of 10,000 pairs; at 0.9 in one of ten million.  Most pairs beyond that distance meet too: a
pair misses all buckets only with two errors or more in each chunk, which happens to 3 of 10,000,000 pairs at
0.85 and to 2 or 3 of 100,000 at 0.80.

Near pairs.  Two classes are near if their 4-bit signatures differ in at most ``far(percent)`` positions, six
standard deviations above the mean of pairs at that similarity.  No bucket emits all its pairs.  Each
class is first compared with one other, that of its buckets' members whose keys are shared most (the original among its
copies); then only those members of a bucket that these pairs leave in different components are compared with one another,
and a bucket gives no more than a spanning forest of its near pairs.  What near pairs join is a group.

Links.  Each class's first near pair is confirmed on the full sets (64-bit hashes of the shingles).  Only a group that these links leave in several components is looked at again: its members
outside its largest component meet all its members, near pairs are confirmed in the order of their distance, and
a pair that earlier links join already is passed over, so a block gives no more links than it has members.  Both
comparisons work in blocks of at most ``BLOCK`` members and ``BLOCK_BYTES`` of sets on each side: no task holds a
whole bucket or group.

Cases: a document without words, or with a null text, has the empty set and is linked with nothing; equal
rows are in one class; a null key never is a component's smallest key unless all keys in it are null; an empty
table gives an empty table; texts are read whole; ``keep_one`` returns all columns of its input as they are,
whatever their names.  Ids of classes are 64-bit hashes of sets: among n classes two are confused with a chance
of n * n / 2 ** 65.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bit_map, columns_of, parted, python_ready, release, row_hash, settled

SHINGLE = 5
POSITIONS = 512
CHUNKS, WIDTH = 10, 6
INDEX = CHUNKS * WIDTH
BYTES = INDEX + POSITIONS // 2
BLOCK = 1024
BLOCK_BYTES = 8 << 20
REMEMBERED = 50_000

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_C = _rng.integers(0, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def forget() -> None:
    """Drop the remembered words at a partition's end, since the worker is kept for other stages."""
    _words.clear()
    release()


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    h = w[: n - SHINGLE + 1] * _C[0]
    for i in range(1, SHINGLE):
        h += w[i : n - SHINGLE + 1 + i] * _C[i]
    return np.unique(_mixed(h))


def signature(hashes: np.ndarray) -> bytes:
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        part = x[at : at + 512, None] * _A
        part += _B
        np.minimum(least, part.min(axis=0), out=least)
    least = (least * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8)
    return least[:INDEX].tobytes() + (least[::2] & 15 | least[1::2] << 4).tobytes()


def _packed(sig: np.ndarray) -> np.ndarray:
    """The 4-bit parts of signatures (rows), 16 to a word."""
    return np.ascontiguousarray(sig[:, INDEX:]).view(np.uint64)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions in which rows of packed signatures differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    return np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def far(percent: int) -> int:
    """Positions in which signatures of linked pairs differ at most: six standard deviations above the mean at ``percent``."""
    p = (1 - percent / 100) * 15 / 16
    return math.floor(POSITIONS * p + 6 * math.sqrt(POSITIONS * p * (1 - p)))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have at least ``percent`` hundredths of their union in common."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``u`` (row hash), ``n_shingles``, ``rid`` (class; null for the empty set), ``sig``."""
    python_ready(df.sparkSession)
    rows = df.select(F.col(key).alias("_key"), row_hash(key, text).alias("u"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rid, sig = [], [], []
            for t in b.column("_text").to_pylist():
                s = shingles(t)
                n.append(len(s))
                rid.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())))) if len(s) else None)
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("u"), pa.array(n, pa.int64()), pa.array(rid, pa.int64()), pa.array(sig, pa.binary())], names=["_key", "u", "n_shingles", "rid", "sig"])
        forget()

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, u long, n_shingles long, rid long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BYTES)


def keys(reps: DataFrame) -> DataFrame:
    """``key``, ``rid``: all keys of each class, one for each chunk and left-out position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            sig, rid, out = _matrix(b.column("sig")).astype(np.int64), b.column("rid").to_numpy(), []
            for c in range(CHUNKS):
                for left_out in range(WIDTH):
                    k = np.full(len(b), c * WIDTH + left_out, np.int64)
                    for i in range(WIDTH):
                        if i != left_out:
                            k = k << 8 | sig[:, c * WIDTH + i]
                    out.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.tile(rid, len(out)))], names=["key", "rid"])

    return reps.mapInArrow(run, "key long, rid long")


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``column`` of both ends.  The column is wide, so no side is broadcast."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("rid").alias(end), F.col(column).alias(f"{column}_{end}")).hint("merge"), end)
    return pairs


def _near(pairs: DataFrame, reps: DataFrame, most: int) -> DataFrame:
    """The pairs whose signatures differ in at most ``most`` positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                ok = _distance(_packed(_matrix(b.column("sig_a"))), _packed(_matrix(b.column("sig_b")))) <= most
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return _beside(pairs, reps, "sig").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have at least ``percent`` hundredths of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("set_a"), b.column("set_b"), strict=True)  # views, no copies
            ok = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in both]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    return _beside(pairs, sets, "set").mapInArrow(run, "a long, b long")


def _sets(df: DataFrame, key: str, text: str, found: DataFrame, rids: DataFrame) -> DataFrame:
    """``rid``, ``set``: the full set of each class in ``rids``, from one document of it."""
    chosen = settled(found.join(rids, "rid", "left_semi").groupBy("rid").agg(F.min("u").alias("u")), "chosen")
    rows = df.select(row_hash(key, text).alias("u"), F.col(text).alias("_text"))
    rows, _ = parted(rows, "u", bit_map(chosen, "u"))  # few of the other texts are shuffled
    rows = rows.join(chosen.hint("merge"), "u")
    repeated = not found.select("u").join(chosen, "u").groupBy("u").count().filter("count > 1").isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array([shingles(t).tobytes() for t in b.column("_text").to_pylist()], pa.binary())], names=["rid", "set"])
        forget()

    if repeated:  # rows alike in key and text
        rows = rows.groupBy("rid").agg(F.first("_text").alias("_text"))
    return rows.select("rid", "_text").mapInArrow(run, "rid long, set binary")


def components(edges: DataFrame) -> DataFrame:
    """``rid``, ``label`` (the smallest id reachable) of all ids in ``edges`` (``a``, ``b``).

    Each turn takes the least label of the neighbours and then the label of the label, until nothing changes."""
    both = settled(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settled(both.groupBy(F.col("a").alias("rid")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        seen = both.join(labels.select(F.col("rid").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("rid")).agg(F.min("l").alias("m"))
        lower = labels.join(seen, "rid").select("rid", F.col("label").alias("old"), F.least("label", "m").alias("mid"))
        jump = labels.select(F.col("rid").alias("mid"), F.col("label").alias("end"))
        now = settled(lower.join(jump, "mid").select("rid", F.least("mid", "end").alias("label"), (F.least("mid", "end") != F.col("old")).alias("moved")), "labels")
        labels = now.select("rid", "label")
        if now.filter("moved").isEmpty():
            return labels


class _Parts:
    """Disjoint sets of the numbers under ``n``."""

    def __init__(self, n: int):
        self.above, self.n = list(range(n)), n

    def top(self, i: int) -> int:
        above = self.above
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.above[max(i, j)] = min(i, j)
            self.n -= 1


def _forest(right: np.ndarray, rid: np.ndarray, comp: np.ndarray, only: np.ndarray, sig: np.ndarray, sets: list[np.ndarray] | None, most: int, percent: int) -> list[tuple[int, int]]:
    """Near pairs (confirmed, if there are ``sets``) of left and right rows that join components: no more than it takes.

    ``only``: whether a right row is a left row of another block or of this one, so that the pair is seen twice."""
    left, right = np.flatnonzero(~right), np.flatnonzero(right)
    packed = _packed(sig)
    across, found = packed[right], []
    for i in left.tolist():
        apart = (comp[right] != comp[i]) & (~only[right] | (rid[right] > rid[i]))
        if apart.any():
            d = _distance(across, packed[i])
            at = np.flatnonzero(apart & (d <= most))
            if len(at):
                found.append((d[at].astype(np.int16), np.full(len(at), i, np.int32), right[at].astype(np.int32)))
    if not found:
        return []
    d, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
    found.clear()
    order = np.argsort(d, kind="stable").astype(np.int32)
    numbers = np.unique(comp, return_inverse=True)[1].tolist()
    parts, out = _Parts(max(numbers) + 1), []
    in_order = (pair for at in range(0, len(order), 4096) for pair in zip(x[order[at : at + 4096]].tolist(), y[order[at : at + 4096]].tolist(), strict=True))
    for i, j in in_order:
        p, q = parts.top(numbers[i]), parts.top(numbers[j])
        if p != q and (sets is None or _alike(sets[i], sets[j], percent)):
            parts.join(p, q)
            out.append((min(int(rid[i]), int(rid[j])), max(int(rid[i]), int(rid[j]))))
            if parts.n == 1:
                break
    return out


def _across(members: DataFrame, reps: DataFrame, sets: DataFrame | None, most: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` that join different components (``comp``) of a group ``g``; ``members``: ``g``, ``rid``, ``comp``, ``size``.

    Members outside a group's largest component are the left side, all members the right one; both go in blocks."""
    members = settled(members, "members")
    each = members.groupBy("g", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    one = F.max_by(F.struct("comp", "n", "size"), F.struct("n", "comp"))
    whole = each.groupBy("g").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("size").alias("size"), one.alias("main")).filter("comps > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")

    n, size, main = F.col("n"), F.col("size"), F.col("main")
    plan = whole.select("g", main["comp"].alias("main"), blocks(n - main["n"], size - main["size"]).alias("lefts"), blocks(n, size).alias("rights"))
    rows = members.join(settled(plan, "blocks"), "g").join(reps.select("rid", "sig").hint("merge"), "rid")
    columns = ["g", "rid", "comp", "sig"]
    if sets is not None:
        rows, columns = rows.join(sets.hint("merge"), "rid"), [*columns, "set"]
    outside = F.col("comp") != F.col("main")

    def deal(count: str, body: Callable[[Column, Column], Column]) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col(count) - 1), lambda k: body(k, F.pmod(F.xxhash64("rid"), F.col("lefts" if count == "rights" else "rights")).cast("int")))

    as_left = F.when(outside, deal("rights", lambda k, own: F.struct(own.alias("i"), k.alias("j"), F.lit(False).alias("right"))))
    as_right = deal("lefts", lambda k, own: F.struct(k.alias("i"), own.alias("j"), F.lit(True).alias("right")))
    rows = rows.withColumn("at", F.explode(F.concat(F.coalesce(as_left, F.array().cast("array<struct<i:int,j:int,right:boolean>>")), as_right)))
    rows = rows.select("at.*", outside.alias("outside"), *columns)
    dealt = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            right, only = (t.column(c).to_numpy(zero_copy_only=False) for c in ("right", "outside"))
            rid, comp = t.column("rid").to_numpy(), t.column("comp").to_numpy()
            own = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")] if "set" in t.column_names else None
            found = _forest(right, rid, comp, only, _matrix(t.column("sig")), own, most, percent) if len(t) > 1 else []
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for b in batches:
            if not len(b):
                continue
            at = np.stack([b.column(c).to_numpy() for c in ("g", "i", "j")])
            edges = [0, *(np.flatnonzero((np.diff(at) != 0).any(axis=0)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = b.slice(lo, hi - lo)
                if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in ("g", "i", "j")):
                    yield from flush()
                    held.clear()
                held.append(part)
        if held:
            yield from flush()
        held.clear()
        release()

    return dealt.mapInArrow(run, "a long, b long")


def _in(labels: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the label of their ``rid`` as ``name``: its own id where it has none."""
    return rows.join(labels, "rid", "left").withColumn(name, F.coalesce("label", F.col("rid"))).drop("label")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` after more ``edges``: only the components that these join are gone through again."""
    ends = edges.select("a", "b")
    for end in ("a", "b"):
        ends = _in(labels, ends.withColumnRenamed(end, "rid"), "_l").drop("rid").withColumnRenamed("_l", end)
    over = components(ends.filter("a <> b"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("rid")).distinct().join(labels, "rid", "left_anti")
    every = labels.unionByName(alone.select("rid", F.col("rid").alias("label")))
    top = over.select(F.col("rid").alias("label"), F.col("label").alias("top"))
    return settled(every.join(top, "label", "left").select("rid", F.coalesce("top", "label").alias("label")), "labels")


def link(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> tuple[DataFrame, DataFrame]:
    """All rows' classes (``_key``, ``u``, ``n_shingles``, ``rid``) and the labels of the classes that have links."""
    most = far(percent)
    found = settled(classes(df, key, text), "classes")
    reps = settled(found.filter("rid is not null").select("rid", "sig", F.col("n_shingles").alias("n")).dropDuplicates(["rid"]), "signatures")
    each = keys(reps)
    counts = settled(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    shared = settled(each.join(counts, "key"), "shared")
    popular = settled(shared.groupBy("rid").agg(F.sum("n").alias("popular")), "popular")
    best = F.max_by(F.struct(F.col("rid").alias("center"), "popular"), F.struct("popular", -F.col("rid")))
    centers = settled(shared.join(popular, "rid").groupBy("key").agg(best.alias("best")).select("key", "best.*"), "centers")
    beside = shared.join(centers, "key").filter(F.col("rid") != F.col("center"))
    star = beside.groupBy("rid").agg(F.max_by("center", F.struct("popular", -F.col("center"))).alias("center"))
    star = star.select(F.least("rid", "center").alias("a"), F.greatest("rid", "center").alias("b")).distinct()
    near = settled(_near(star, reps, most), "near")

    # groups: what near pairs join
    groups = components(near)
    others = _in(groups, shared.select(F.col("key").alias("g"), "rid"), "comp").withColumn("size", F.lit(BYTES).cast("long"))
    more = settled(_across(others, reps, None, most, percent).distinct(), "more")
    if not more.isEmpty():
        groups = merged(groups, more)

    # links: near pairs that their sets confirm, and what they leave apart in a group
    sets = settled(_sets(df, key, text, found, groups.select("rid")), "sets")
    links = settled(_linked(near, sets, percent), "links")
    labels = components(links)
    members = _in(labels, groups.withColumnRenamed("label", "g"), "comp").join(reps.select("rid", (8 * F.col("n")).alias("size")), "rid")
    rest = settled(_across(members, reps, sets, most, percent), "rest")
    if not rest.isEmpty():
        labels = merged(labels, rest)
    return found.drop("sig"), labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` (smallest key reachable), ``kept``, ``row_hash`` of each row."""
    found, labels = link(df, key, text, percent)
    labelled = settled(found.join(labels, "rid", "left").withColumn("group", F.coalesce("label", "rid")), "labelled")
    # as a table, so that the join below has two exchanges and the rows of a large group can be split
    groups = settled(labelled.filter("group is not null").groupBy("group").agg(F.min("_key").alias("least")), "groups")
    joined = labelled.join(groups, "group", "left")
    component = F.when(F.col("group").isNull(), F.col("_key")).otherwise(F.col("least"))
    return joined.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"), F.col("u").alias("row_hash"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` that are their component's smallest key; of rows alike in that key, all that are alike in text."""
    gone = settled(near_duplicates(df.select(key, text), key, text, percent).filter("not kept").select(F.col("row_hash").alias("u")).distinct(), "gone")
    rows = df.select(F.struct(*columns_of(df)).alias("row"), row_hash(key, text).alias("u"))
    maybe, untouched = parted(rows, "u", bit_map(gone, "u"))
    return maybe.join(gone.hint("merge"), "u", "left_anti").select("row.*").unionByName(untouched.select("row.*"))
