"""Expressions over path names and the values that come with them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """What follows the last slash: all of a name without one, nothing of one that ends in it."""
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """What precedes the last slash; ``/`` for an entry of the root, null for a name without a slash."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)
    return F.when(F.instr(path, "/") == 0, F.lit(None)).when(head == "", F.lit("/")).otherwise(head)


def ancestors(path: Column) -> Column:
    """All proper ancestor directories, from the top: each prefix that ends before a slash, the root left out."""
    parts = F.split(path, "/")
    deep = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts))
    return F.filter(F.transform(deep, lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda p: p != "")


def join_path(directory: Column, name: Column) -> Column:
    """A directory and a name with one slash between them, at the root too."""
    return F.when(directory.endswith("/"), F.concat(directory, name)).otherwise(F.concat(directory, F.lit("/"), name))


def is_child(path: Column, directory: Column) -> Column:
    """Whether ``path`` is an entry of ``directory`` itself."""
    base = F.when(directory.endswith("/"), directory).otherwise(F.concat(directory, F.lit("/")))
    rest = F.substring(path, F.length(base) + 1, F.length(path))
    return path.startswith(base) & (rest != "") & (F.instr(rest, "/") == 0)


def dir_order_key(path: Column) -> Column:
    """Sorts as bytes, with the slash below every other byte and a prefix first."""
    return F.split(path, "/")


def trigrams(raw: Column) -> Column:
    """The distinct trigrams of a binary value as hexadecimal strings; none below three bytes."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.octet_length(raw) - 2, F.lit(1))), lambda i: i + 2 <= F.octet_length(raw))
    return F.array_distinct(F.transform(places, lambda i: F.hex(F.substring(raw, i, F.lit(3)))))


def fs_type(name: Column) -> Column:
    return F.upper(name)


def words(text: Column) -> Column:
    """A list that is separated by white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def flag(text: Column) -> Column:
    """``0``, ``no``, ``1`` or ``yes`` as a boolean; anything else is null."""
    return F.when(text.isin("1", "yes"), True).when(text.isin("0", "no"), False)


def octal_unescape(text: Column) -> Column:
    """A backslash and three octal digits are a byte."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)(\\[0-3][0-7]{2}|[^\\]+|\\)"), F.lit(1))

    def value(p: Column) -> Column:
        return F.unhex(F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0"))

    raw = F.transform(parts, lambda p: F.when(p.rlike(r"^\\[0-3][0-7]{2}$"), value(p)).otherwise(F.encode(p, "UTF-8")))
    return F.decode(F.aggregate(raw, F.unhex(F.lit("")), lambda a, b: F.concat(a, b)), "UTF-8")


def dir_time(changed: Column, modified: Column, now_sec: Column | None = None, settle_sec: int = 3) -> Column:
    """The later of two times (``sec``, ``nsec``); (0, 0), unknown, where it is so near ``now_sec`` that a
    change in the same tick could go unseen."""
    later = F.greatest(changed, modified)
    unknown = F.struct(F.lit(0).cast("long").alias("sec"), F.lit(0).alias("nsec"))
    return later if now_sec is None else F.when(later["sec"] >= now_sec - settle_sec, unknown).otherwise(later)


def prefix_of(a: Column, b: Column) -> Column:
    return b.startswith(a)


_ESCAPES = {7: "\\a", 8: "\\b", 9: "\\t", 10: "\\n", 11: "\\v", 12: "\\f", 13: "\\r", 34: '\\"', 39: "\\'", 92: "\\\\"}


_UNSAFE = r"""(?s)[\x00-\x1f'"\\`]"""
#: The well-formed sequences of UTF-8, a byte to a character.
_UTF8 = r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"


def characters(raw: Column) -> Column:
    """The characters of a binary value that should be UTF-8; null for each byte that is part of none."""
    each = F.regexp_extract_all(F.decode(raw, "ISO-8859-1"), F.lit(f"(?s)({_UTF8}|.)"), F.lit(1))
    return F.transform(each, lambda c: F.when((F.length(c) > 1) | (c < "\x80"), F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")))


def shell_quote(path: Column) -> Column:
    """A name as a shell reads it back: as it is where it is safe, else in single quotes, with runs of control
    characters, quotes and backslashes as ``'$'...''``.  A backtick asks for quotes and stands in them."""
    return F.when(~path.rlike(_UNSAFE), path).otherwise(_in_quotes(F.filter(F.split(path, ""), lambda c: c != "")))


def shell_quote_bytes(raw: Column) -> Column:
    """The same for a name in bytes: one that is no UTF-8 is quoted, with a question mark for each byte that is none."""
    chars = characters(raw)
    text = F.array_join(chars, "")
    safe = ~F.exists(chars, lambda c: c.isNull()) & ~text.rlike(_UNSAFE)
    return F.when(safe, text).otherwise(_in_quotes(chars))


def _in_quotes(chars: Column) -> Column:

    def escaped(c: Column) -> Column:
        out = F.when(c == chr(7), F.lit("\\a"))
        for code, text in _ESCAPES.items():
            out = out.when(c == chr(code), F.lit(text))
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(F.hex(F.encode(c, "UTF-8")), 16, 8), 3, "0"))
        return out.when(c < " ", octal)

    def step(state: Column, c: Column) -> Column:
        e = escaped(c)
        opened = F.when(state["in"], F.lit("")).otherwise(F.lit("'$'"))
        closed = F.when(state["in"], F.lit("''")).otherwise(F.lit(""))
        text = F.when(c.isNull(), F.concat(state["out"], F.lit("?"))).when(e.isNotNull(), F.concat(state["out"], opened, e)).otherwise(F.concat(state["out"], closed, c))
        return F.struct(text.alias("out"), F.when(c.isNull(), state["in"]).otherwise(e.isNotNull()).alias("in"))

    start = F.struct(F.lit("'").alias("out"), F.lit(False).alias("in"))
    return F.aggregate(chars, start, step, lambda s: F.concat(s["out"], F.lit("'")))


def lines(path: Column, end: str = "\n") -> Column:
    """A name as it is written to a stream: with a line feed, or with a zero byte."""
    return F.concat(path, F.lit(end))
