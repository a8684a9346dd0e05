"""From needles to required trigrams: a conjunction of groups, in each of which one trigram must occur.

A trigram is three consecutive bytes of a name's UTF-8, written as six hexadecimal digits.  The groups are a
lossless filter: a name that matches has a trigram of every group.  What they let through is verified.
"""

from __future__ import annotations

from collections.abc import Iterable

from pathweave.functions.patterns import Needle, case_variants, runs

#: Beyond so many alternatives at one place no group is made there.
MOST_STATES = 100
Groups = list[frozenset[str]]


def _exact(text: str) -> Groups:
    raw = text.encode()
    return [frozenset([raw[i : i + 3].hex().upper()]) for i in range(len(raw) - 2)]


def _folded(text: str) -> Groups:
    """For each character, the first three bytes of all ways to write what begins there."""
    variants = [None if v is None else [x.encode() for x in v] for v in map(case_variants, text)]
    out = []
    for i in range(len(text)):
        states, j = {b""}, i
        while any(len(s) < 3 for s in states):
            if j == len(text) or variants[j] is None:
                states = set()
                break
            states = {s if len(s) >= 3 else (s + v)[:3] for s in states for v in (variants[j] if len(s) < 3 else [b""])}
            if len(states) > MOST_STATES:
                states = set()
                break
            j += 1
        if states:
            out.append(frozenset(s.hex().upper() for s in states))
    return out


def plan(needles: Iterable[Needle]) -> Groups:
    """The groups of all needles, each once; none means that every name has to be read."""
    found: dict[frozenset[str], None] = {}
    for needle in needles:
        literals = needle.literals if needle.kind != "glob" else runs(list(needle.tokens))
        for text in literals:
            for group in _folded(text) if needle.ignore_case else _exact(text):
                found[group] = None
    return list(found)


def cut(groups: Groups, counts: dict[str, int], factor: int = 100) -> Groups:
    """The groups in the order of their sizes, up to the first that is more than ``factor`` times the least.

    ``counts``: postings of each trigram.  A group beyond the cut would cost more to read than it can save."""
    size = {g: sum(counts.get(t, 0) for t in g) for g in groups}
    ordered = sorted(groups, key=lambda g: (size[g], sorted(g)))
    return [g for g in ordered if size[g] <= factor * max(1, size[ordered[0]])]


def shown(group: frozenset[str]) -> str:
    """A group for people: printable bytes as they are, others escaped."""

    def one(trigram: str) -> str:
        return "".join(chr(b) if 32 < b < 127 else f"\\x{b:02x}" for b in bytes.fromhex(trigram))

    return "(" + " | ".join(one(t) for t in sorted(group)) + ")"
