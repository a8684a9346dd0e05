"""Line deduplication by content-defined chunks and by runs of lines, in DataFrame functions only.

Each line is hashed.  A rolling hash over two neighbouring line hashes (a rotation and an exclusive or)
chooses the boundaries: a chunk begins after a line whose rolling hash is a local minimum, so a boundary
depends on four lines around it and on nothing farther away, and an inserted or removed line moves no
boundary beyond its neighbourhood.  Chunks therefore have two lines or more, but for a text of one line.

One rule says what is compared: a chunk in which two lines or more have words, however short or long they are.

A boundary depends on the text around it, so a short passage between changing lines may be in no chunk that
recurs.  With ``least_words`` (50; 0: chunks alone) the shortest runs of neighbouring lines that reach so many words
are compared too, one from each line onwards and one from each line back.  They cover a repeated passage of
whole lines: if it has ``least_words`` words, each of its lines is in such a run that lies inside it, so it is
found from its first line to its last, whatever stands around it.

Pieces (chunks and runs) whose hashes occur more than once anywhere are brought together and compared as bytes
(the texts are grouping keys); of equal pieces the first stays, in the order of key, row hash and place, and the
others' lines are taken out of their documents, but for lines of that first piece itself where the two overlap.
A line goes only if it stands earlier too, so the first of each line stays somewhere.  Two different pieces with
one hash are told apart and treated each for itself.

Cases: a null text stays null; an empty one stays empty; a document that only had repeats becomes empty, and
``n_removed`` says how many lines it lost; rows alike in key and text are one document: they lose the same
lines, and none because of each other; a null key sorts last; an empty table gives an empty table; texts are
read whole, in time that is linear in their lines; other columns pass through whatever their names, but for one named
like ``out`` (``n_removed``), which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, bit_map, columns_of, parted, row_hash, settled

LEAST_WORDS = 50
_TURN = 21
#: Lines that a run is looked for in before as many as it may take.
_FEW = 8


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(text: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of the text's lines, their marks (``h``, ``words``) and the numbers of the lines that begin chunks."""

    def from_lines(lines: Column) -> Column:
        each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), x.rlike(WORD).alias("words")))
        return _bound(each, lambda marks: from_marks(lines, marks))

    def from_marks(lines: Column, marks: Column) -> Column:
        def turned(h: Column) -> Column:
            return F.shiftleft(h, _TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - _TURN))

        rolled = F.transform(marks, lambda m, i: m["h"].bitwiseXOR(turned(F.coalesce(F.get(marks, i - 1)["h"], F.lit(0).cast("long")))))
        return _bound(rolled, lambda r: from_rolled(lines, marks, r))

    def from_rolled(lines: Column, marks: Column, r: Column) -> Column:
        def begins(i: Column) -> Column:
            least = (F.get(r, i - 1) < F.get(r, i - 2)) & (F.get(r, i - 1) <= F.get(r, i))
            return (i == 0) | F.coalesce(least, F.lit(False))

        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)
        return _bound(starts, lambda s: body(lines, marks, s))

    return _bound(F.split(text, "\n"), from_lines)


def chunks(text: Column) -> Column:
    """An array of the text's chunks: ``h`` (hash), ``n`` (lines), ``chunk`` (text).  Their texts, joined by line feeds, are the text."""

    def from_starts(lines: Column, marks: Column, s: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(s, k + 1), F.size(lines)) - at
            return _bound(F.array_join(F.slice(lines, at + 1, n), "\n"), lambda t: F.struct(F.xxhash64(t, n).alias("h"), n.alias("n"), t.alias("chunk")))

        return F.transform(s, one)

    return _cut(text, from_starts)


def _place(at: Column, n: Column) -> Column:
    """Lines ``at`` to ``at + n - 1`` as one number, which sorts by ``at``."""
    return F.shiftleft(at.cast("long"), 32).bitwiseOR(n.cast("long"))


def _at(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def _n(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _joined(lines: Column, place: Column) -> Column:
    return F.array_join(F.slice(lines, _at(place) + 1, _n(place)), "\n")


def runs(lines: Column, least_words: int = LEAST_WORDS) -> Column:
    """Places of the shortest runs of lines with ``least_words`` words, onwards and back from each line that has words."""
    unit = 1 << 20  # a sum has the words in its units and the lines below

    def reached(c: Column) -> Column:
        """For each place in ``c``, how many values from there on make up ``least_words``; null if all are too few."""

        def summed(k: Column, most: int) -> Column:
            return F.aggregate(F.slice(c, k + 1, most), F.lit(0).cast("long"), lambda a, x: F.when(a >= least_words * unit, a).otherwise(a + x * unit + 1))

        def one(few: Column, k: Column) -> Column:
            whole = F.when(few >= least_words * unit, few).otherwise(summed(k, least_words))
            return _bound(whole, lambda a: F.when(a >= least_words * unit, a.bitwiseAND(F.lit(unit - 1)).cast("int")))

        return F.transform(F.transform(c, lambda _, k: summed(k, min(_FEW, least_words))), one)

    def from_counts(counts: Column) -> Column:
        return _bound(F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) > 0), lambda at: from_places(counts, at))

    def from_places(counts: Column, at: Column) -> Column:
        return _bound(F.transform(at, lambda i: F.get(counts, i)), lambda c: from_both(at, c))

    def from_both(at: Column, c: Column) -> Column:
        def onwards(n: Column, k: Column) -> Column:
            return _place(F.get(at, k), F.get(at, k + n - 1) - F.get(at, k) + 1)

        def back(n: Column, k: Column) -> Column:
            last = F.size(at) - 1 - k
            first = F.get(at, last - n + 1)
            return _place(first, F.get(at, last) - first + 1)

        return F.array_compact(F.concat(F.transform(reached(c), onwards), F.transform(_bound(F.reverse(c), reached), back)))

    return _bound(F.transform(lines, lambda x: F.least(F.regexp_count(x, F.lit(WORD)), F.lit(least_words)).cast("long")), from_counts)


def pieces(text: Column, least_words: int = LEAST_WORDS) -> Column:
    """An array of the compared pieces of a text: ``h`` (hash of their lines' hashes) and ``place``."""

    def from_starts(lines: Column, marks: Column, s: Column) -> Column:
        def compared(at: Column, k: Column) -> Column:
            n = F.coalesce(F.get(s, k + 1), F.size(lines)) - at
            worded = F.filter(F.slice(marks, at + 1, n), lambda m: m["words"])
            return F.when(F.size(worded) > 1, _place(at, n))

        places = F.array_compact(F.transform(s, compared))
        if least_words:
            places = F.array_distinct(F.concat(places, runs(lines, least_words)))
        hashes = F.transform(marks, lambda m: m["h"])
        return _bound(hashes, lambda h: F.transform(places, lambda p: F.struct(F.xxhash64(F.slice(h, _at(p) + 1, _n(p))).alias("h"), p.alias("place"))))

    return _cut(text, from_starts)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The lines to take out: ``_key``, ``_row`` (hash of key and text), ``places`` (of runs of lines, which may overlap)."""
    docs = df.select(F.col(key).alias("_key"), row_hash(key, text).alias("_row"), F.col(text).alias("_text")).filter(F.col("_text") != "")
    narrow = docs.select("_key", "_row", F.explode(pieces(F.col("_text"), least_words)).alias("x"))
    # rows alike are one document
    all_pieces = settled(narrow.select("_key", "_row", "x.h", "x.place"), "pieces")
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key"), F.col("_row"), F.col("place"))
    seen = all_pieces.groupBy("h").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    twice = settled(seen.filter((F.col("n") > 1) & (F.col("first") != F.col("last"))).select("h", "first"), "twice")
    found = settled(all_pieces.join(twice.select("h"), "h", "left_semi").select("_key", "_row", "place", "h"), "found")

    # the bytes of the pieces found, each with its hash; texts that agree are summed where they are read
    where = found.groupBy("_key", "_row").agg(F.collect_set(F.struct("h", "place")).alias("places")).withColumnRenamed("_key", "_k").withColumnRenamed("_row", "_r")
    maybe, _ = parted(docs, "_row", bit_map(found.select("_row").distinct(), "_row"))  # few of the other texts are shuffled
    wanted = maybe.join(where.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")))
    listed = _bound(F.split("_text", "\n"), lambda lines: F.transform("places", lambda x: F.struct(x["h"].alias("h"), _joined(lines, x["place"]).alias("piece"), x["place"].alias("place"))))
    texts = wanted.select("_key", "_row", F.explode(listed).alias("x")).select("_key", "_row", "x.*")
    differ = texts.groupBy("h", "piece").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    differ = settled(differ.select("h"), "differ")

    def later(rows: DataFrame, firsts: DataFrame, by: list[str]) -> DataFrame:
        at, n, first = _at(F.col("place")), _n(F.col("place")), F.col("first")
        here = first["_key"].eqNullSafe(F.col("_key")) & (first["_row"] == F.col("_row"))
        start = F.when(here, F.greatest(at, _at(first["place"]) + n)).otherwise(at)  # the first piece's own lines stay
        return rows.join(firsts, by).filter(order != first).select("_key", "_row", _place(start, at + n - start).alias("place"))

    equal = later(found.join(differ, "h", "left_anti"), twice, ["h"])
    if not differ.isEmpty():  # pieces of one hash and different bytes: by their texts
        rows = settled(texts.join(differ, "h", "left_semi").dropDuplicates(["_key", "_row", "place"]), "texts")
        firsts = rows.groupBy("h", "piece").agg(F.min(order).alias("first"))
        equal = equal.unionByName(later(rows, firsts, ["h", "piece"]))
    return equal.groupBy("_key", "_row").agg(F.collect_set("place").alias("places"))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, out: str = "n_removed") -> DataFrame:
    """``df`` with repeated chunks, and repeated runs of ``least_words`` words, taken out of ``text``, and ``out``, the number of lines taken out."""
    found = settled(repeats(df, key, text, least_words).withColumnRenamed("_key", "_k").withColumnRenamed("_row", "_r"), "repeats")
    rows = df.select(F.struct(*columns_of(df)).alias("row"), F.col(key).alias("_key"), row_hash(key, text).alias("_row"))
    maybe, untouched = parted(rows, "_row", bit_map(found.select("_r"), "_r"))
    joined = maybe.join(found.hint("merge"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left")
    gone = F.flatten(F.transform("places", lambda p: F.sequence(_at(p), _at(p) + _n(p) - 1)))

    def stay(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return _bound(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(k)).cast("long").alias("n")))

    with_cut = joined.withColumn("cut", F.when(F.col("places").isNotNull(), _bound(F.split(F.col("row")[text], "\n"), stay)))
    names = [c for c in df.columns if c.lower() != out.lower()]
    columns = [F.coalesce(F.col("cut")["text"], F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in names]
    done = with_cut.select(*columns, F.coalesce(F.col("cut")["n"], F.lit(0).cast("long")).alias(out))
    return done.unionByName(untouched.select(*[F.col("row")[c].alias(c) for c in names], F.lit(0).cast("long").alias(out)))
