"""Patterns of a search: how a string is classified, and what regular expression means the same to the JVM.

Three kinds of needles: a plain substring, a glob over the whole string, and a POSIX basic or extended regular
expression found anywhere.  All parsing is done here, on the driver; what comes out is a Column of built-in
expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import Column

#: POSIX character classes as they stand inside a JVM character class.
CLASSES = {
    "alpha": r"\p{IsAlphabetic}", "digit": "0-9", "alnum": r"\p{IsAlphabetic}0-9", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}",
    "space": r"\s\x0B", "blank": r" \t", "punct": r"\p{Punct}", "print": r"\p{Graph}\x20\P{ASCII}", "graph": r"\p{Graph}\P{ASCII}", "cntrl": r"\p{Cntrl}", "xdigit": "0-9A-Fa-f",
}


class PatternError(ValueError):
    """A pattern that has no meaning, such as one that ends in the middle."""


@dataclass(frozen=True)
class Token:
    """A piece of a glob: ``lit`` (one character), ``any`` (?), ``star`` (*), ``set`` ([...], as a JVM class) or ``end`` (it broke off)."""

    kind: str
    text: str = ""


def _quoted(c: str) -> str:
    return c if c.isalnum() or c in "_/" or ord(c) > 127 else f"\\x{ord(c):02x}"


def _bracket(p: str, i: int, escapes: bool, negations: str) -> tuple[str, int] | None:
    """The bracket expression that begins at ``p[i]`` as a JVM class, and where it ends; None if it never ends."""
    j = i + 1
    negated = j < len(p) and p[j] in negations
    j += negated
    items: list[str] = []
    first = True
    while j < len(p):
        c = p[j]
        if c == "]" and not first:
            return "[" + ("^" if negated else "") + "".join(items) + "]", j + 1
        first = False
        if c == "[" and j + 1 < len(p) and p[j + 1] in ":.=":
            mark = p[j + 1]
            end = p.find(mark + "]", j + 2)
            if end < 0:
                return None
            name = p[j + 2 : end]
            if mark == ":":
                if name not in CLASSES:
                    raise PatternError(f"unknown character class {name!r}")
                items.append(CLASSES[name])
                j = end + 2
                continue
            if len(name) != 1:
                raise PatternError(f"unknown collating element {name!r}")
            c, j = name, end + 2
        elif c == "\\" and escapes:
            if j + 1 >= len(p):
                return None
            c, j = p[j + 1], j + 2
        else:
            j += 1
        if j + 1 < len(p) and p[j] == "-" and p[j + 1] != "]":
            k = j + 1
            if p[k] == "\\" and escapes and k + 1 < len(p):
                k += 1
            last, j = p[k], k + 1
            if last == "[" and j < len(p) and p[j] == ".":
                end = p.find(".]", j + 1)
                if end < 0:
                    return None
                last, j = p[j + 1 : end], end + 2
            if len(last) != 1 or last < c:
                raise PatternError(f"range out of order in {p!r}")
            items.append(f"{_quoted(c)}-{_quoted(last)}")
        else:
            items.append(_quoted(c))
    return None


def glob_tokens(pattern: str) -> list[Token]:
    """The pieces of a glob; one that breaks off has an ``end`` token at its end."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return [*out, Token("end", "\\")]
            out.append(Token("lit", pattern[i + 1]))
            i += 2
        elif c in "*?":
            out.append(Token("star" if c == "*" else "any"))
            i += 1
        elif c == "[":
            found = _bracket(pattern, i, True, "!^")
            if found is None:
                return [*out, Token("end", pattern[i:])]
            out.append(Token("set", found[0]))
            i = found[1]
        else:
            out.append(Token("lit", c))
            i += 1
    return out


def unescape(pattern: str) -> str:
    """A pattern without wildcards as the string that it means."""
    tokens = glob_tokens(pattern)
    if any(t.kind != "lit" for t in tokens):
        raise PatternError(f"pattern {pattern!r} ends in the middle" if tokens[-1].kind == "end" else f"pattern {pattern!r} has wildcards")
    return "".join(t.text for t in tokens)


def glob_regex(tokens: list[Token], ignore_case: bool = False) -> str:
    """The regular expression of a glob.  ``*`` and ``?`` match any character, a slash too; a bracket that never ends is literal.

    Stars at the ends anchor nothing, so what is between them is looked for anywhere."""
    parts = {"any": lambda t: ".", "star": lambda t: ".*", "lit": lambda t: _quoted(t.text), "set": lambda t: t.text, "end": lambda t: "".join(map(_quoted, t.text))}
    first = next((i for i, t in enumerate(tokens) if t.kind != "star"), len(tokens))
    last = next((i for i in range(len(tokens), first, -1) if tokens[i - 1].kind != "star"), first)
    body = "".join(parts[t.kind](t) for t in tokens[first:last])
    begin, end = "" if first else r"\A", "" if last < len(tokens) else r"\z"
    return f"(?s{'iu' if ignore_case else ''}){begin}{body}{end}"


def runs(tokens: list[Token]) -> list[str]:
    """The literal runs between wildcards."""
    out = [""]
    for t in tokens:
        if t.kind in ("lit", "end"):
            out[-1] += t.text
        else:
            out.append("")
    return [r for r in out if r]


class _Posix:
    """Translates a POSIX regular expression; also collects the literals that every match must contain."""

    def __init__(self, pattern: str, extended: bool):
        self.p, self.extended, self.i = pattern, extended, 0
        self.groups = self.depth = 0
        self.closed: set[int] = set()
        self.literals: list[str] = []
        self.run = ""
        self.alternates = False

    def next_special(self) -> tuple[str, str]:
        """What comes next: its role and its text; moves on."""
        c = self.p[self.i]
        if c == "\\":
            if self.i + 1 >= len(self.p):
                raise PatternError("trailing backslash")
            d = self.p[self.i + 1]
            self.i += 2
            if d.isdigit() and d != "0":
                return "back", d
            if d in "wWsSbB":
                return "class", "\\" + d
            if d in "<>":
                return "class", r"\b(?=\w)" if d == "<" else r"\b(?<=\w)"
            if d in "`'":
                return "anchor", r"\A" if d == "`" else r"\z"
            if not self.extended and d in "(){}+?|":
                return {"(": "open", ")": "close", "{": "interval", "}": "lit", "|": "or"}.get(d, "repeat"), d
            return "lit", d
        self.i += 1
        if c == "*":
            return "repeat", c
        if c == ".":
            return "class", "."
        if c == "[":
            found = _bracket(self.p, self.i - 1, False, "^")
            if found is None:
                raise PatternError("unmatched [")
            self.i = found[1]
            return "class", found[0]
        if c in "^$":
            return "anchor", c
        if self.extended and c in "(){+?|":
            return {"(": "open", ")": "close", "{": "interval", "|": "or"}.get(c, "repeat"), c
        return "lit", c

    def interval(self) -> str | None:
        m = re.compile(r"(\d*)(,?)(\d*)" + (r"\}" if self.extended else r"\\\}")).match(self.p, self.i)
        if not m or not (m[1] or m[2]):
            return None
        low, high = int(m[1] or 0), int(m[3]) if m[3] else None
        if high is not None and high < low or low > 32767:
            raise PatternError("invalid content of braces")
        self.i = m.end()
        return f"{{{low}{m[2] or ''}{m[3] if m[2] else ''}}}"

    def ends_here(self) -> bool:
        rest = self.p[self.i :]
        return not rest or rest.startswith((r"\)", r"\|"))

    def drop_last(self) -> None:
        """The last character may be absent: it is no literal that must occur."""
        self.keep(self.run[:-1])

    def keep(self, run: str | None = None) -> None:
        run = self.run if run is None else run
        if run and not self.depth:
            self.literals.append(run)
        self.run = ""

    def sequence(self) -> str:
        out: list[str] = []
        fresh = True  # at the start of an alternative, where * is literal in a basic expression
        while self.i < len(self.p):
            begin = self.i
            role, text = self.next_special()
            if role == "close":
                if self.depth:
                    self.i = begin
                    break
                if not self.extended:
                    raise PatternError("unmatched )")
                role = "lit"
            if role == "anchor" and not self.extended and (text == "^" and not fresh or text == "$" and not self.ends_here()):
                role = "lit"
            if role in ("repeat", "interval") and fresh and not self.extended and text != "*" and role == "interval":
                raise PatternError("nothing to repeat")
            if role == "repeat" and fresh:
                if self.extended:
                    continue  # a leading repetition repeats nothing
                role = "lit"
            if role == "interval":
                many = None if fresh else self.interval()
                if many is None:
                    if not self.extended:
                        raise PatternError("invalid braces")
                    role = "lit"
                else:
                    self.drop_last()
                    out[-1] = f"(?:{out[-1]}){many}"
                    continue
            if role == "repeat":
                if text == "+":
                    self.keep()
                else:
                    self.drop_last()
                out[-1] = f"(?:{out[-1]}){text}"
                continue
            if role == "or":
                self.keep()
                self.alternates |= not self.depth
                out.append("|")
                fresh = True
                continue
            if role == "lit":
                out.append(_quoted(text))
                self.run += text
            elif role == "open":
                self.keep()
                self.groups += 1
                number = self.groups
                self.depth += 1
                inner = self.sequence()
                if self.i >= len(self.p):
                    raise PatternError("unmatched (")
                self.next_special()
                self.run = ""
                self.depth -= 1
                self.closed.add(number)
                out.append(f"({inner})")
            else:
                self.keep()
                if role == "back":
                    if int(text) not in self.closed:
                        raise PatternError("invalid back reference")
                    text = f"(?:\\{text})"
                elif role == "anchor":
                    text = {"^": r"\A", "$": r"\z"}.get(text, text)
                out.append(text)
                if role == "anchor" and text == r"\A" and not self.extended:
                    continue
            fresh = False
        self.keep()
        return "".join(out)


def posix_regex(pattern: str, extended: bool, ignore_case: bool = False) -> tuple[str, list[str]]:
    """The JVM's regular expression for a POSIX one, and literals that every match contains (none where there is an alternative)."""
    parser = _Posix(pattern, extended)
    body = parser.sequence()
    return f"(?s{'iu' if ignore_case else ''}){body}", [] if parser.alternates else parser.literals


@dataclass(frozen=True)
class Needle:
    """One pattern, ready to match: its kind, the string or regular expression, and the literal runs that a match contains."""

    kind: str  #: substring, glob or regex
    text: str
    ignore_case: bool = False
    literals: tuple[str, ...] = field(default=())
    tokens: tuple[Token, ...] = field(default=())


def classify(pattern: str, regex: str | None = None, ignore_case: bool = False) -> Needle:
    """``regex``: ``basic``, ``extended`` or None.  A pattern without wildcards is a substring; one with any is a
    glob over the whole string; without regard to case a plain pattern is the glob with ``*`` on both sides."""
    if regex:
        text, literals = posix_regex(pattern, regex == "extended", ignore_case)
        return Needle("regex", text, ignore_case, tuple(literals))
    tokens = glob_tokens(pattern)
    wild = any(t.kind in ("any", "star", "set") for t in tokens)
    if not wild and not ignore_case:
        plain = unescape(pattern)
        return Needle("substring", plain, False, (plain,), tuple(tokens))
    if not wild:
        tokens = [Token("star"), *tokens, Token("star")]
    return Needle("glob", glob_regex(tokens, ignore_case), ignore_case, tuple(runs(tokens)), tuple(tokens))


def match_column(needle: Needle, haystack: Column) -> Column:
    """Whether ``haystack`` matches.  Plain prefixes, suffixes and infixes use the functions that reach a Parquet scan."""
    if needle.kind == "substring":
        return haystack.contains(needle.text)
    if needle.kind == "glob" and not needle.ignore_case and needle.literals == ("".join(t.text for t in needle.tokens if t.kind == "lit"),):
        kinds = [t.kind for t in needle.tokens if t.kind != "lit"]
        text = needle.literals[0]
        ends = needle.tokens[0].kind, needle.tokens[-1].kind
        if kinds == ["star", "star"] and ends == ("star", "star"):
            return haystack.contains(text)
        if kinds == ["star"] and ends[1] == "star":
            return haystack.startswith(text)
        if kinds == ["star"] and ends[0] == "star":
            return haystack.endswith(text)
    found = haystack.rlike(needle.text)
    longest = max(needle.literals, key=len, default="")
    return haystack.contains(longest) & found if longest and not needle.ignore_case else found


@lru_cache(maxsize=1)
def _folds() -> dict[str, tuple[str, ...]]:
    """For each character, all that the JVM takes for the same without regard to case."""
    by: dict[str, list[str]] = {}
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        upper = c.upper()
        upper = upper if len(upper) == 1 else c
        lower = upper.lower()
        lower = "i" if upper == "İ" else lower if len(lower) == 1 else upper
        if lower != c or c.lower() != c or c.upper() != c:
            by.setdefault(lower, []).append(c)
    return {c: tuple(group) for group in by.values() for c in group}


def case_variants(c: str) -> tuple[str, ...] | None:
    """The characters that match ``c`` without regard to case; None for one whose upper case is several characters."""
    if len(c.upper()) != 1:
        return None
    return _folds().get(c, (c,))
