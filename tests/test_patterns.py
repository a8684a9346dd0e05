import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathweave.functions.patterns import PatternError, classify, glob_tokens, match_column, posix_regex, unescape
from pathweave.plans.trigrams import cut, plan, shown


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "path string")


def hits(spark, values, pattern, **options):
    return [r[0] for r in names(spark, *values).filter(match_column(classify(pattern, **options), F.col("path"))).collect()]


def test_classification():
    assert classify("abc").kind == "substring"
    assert classify(r"a\*b").text == "a*b"
    assert classify("a*b").kind == "glob"
    assert classify("a[bc]").kind == "glob"
    assert classify("abc", ignore_case=True).kind == "glob"
    assert classify("abc", regex="basic").kind == "regex"


@pytest.mark.parametrize("pattern", ["a\\", "a[b", "[", "[!", "[[:alpha:]"])
def test_broken_off(pattern):
    with pytest.raises(PatternError):
        classify(pattern)


def test_unescape():
    assert unescape(r"a\bc\\") == "abc\\"
    with pytest.raises(PatternError):
        unescape("a*")


GLOBS = [
    ("a*c", ["abc", "a/c", "ac", "abcd", "a\nc"], ["abc", "a/c", "ac", "a\nc"]),
    ("a?c", ["abc", "a/c", "ac", "aéc"], ["abc", "a/c", "aéc"]),
    ("[!a]x", ["ax", "bx", "x"], ["bx"]),
    ("[^a]x", ["ax", "bx", "x"], ["bx"]),
    ("[]a]", ["]", "a", "b"], ["]", "a"]),
    ("[!]a]", ["]", "a", "b"], ["b"]),
    ("[a-c]", ["a", "b", "d", "-"], ["a", "b"]),
    ("[a-]", ["a", "-", "b"], ["a", "-"]),
    ("[[:digit:]]*", ["1a", "a1"], ["1a"]),
    (r"\[x\]*", ["[x]", "[x]y", "x"], ["[x]", "[x]y"]),
    (r"[\]]", ["]", "\\"], ["]"]),
    ("*.txt", ["a.txt", "a.txt.gz"], ["a.txt"]),
    ("/a/*", ["/a/b", "/a", "/b/a/"], ["/a/b"]),
    ("*b*", ["abc", "ac"], ["abc"]),
    ("*", ["", "x"], ["", "x"]),
    ("[&&a]", ["&", "a", "b"], ["&", "a"]),
]


@pytest.mark.parametrize(("pattern", "values", "expected"), GLOBS)
def test_globs(spark, pattern, values, expected):
    assert hits(spark, values, pattern) == expected


def test_case(spark):
    values = ["Éa", "éA", "ea", "STRASSE", "straße", "İx", "K", "k"]
    assert hits(spark, values, "éa", ignore_case=True) == ["Éa", "éA"]
    assert hits(spark, values, "strasse", ignore_case=True) == ["STRASSE"]
    assert hits(spark, values, "k", ignore_case=True) == ["K", "k"]


BASIC = [
    (r"a\{2\}", ["aa", "a", "a{2}"], ["aa"]),
    ("a{2}", ["aa", "a{2}"], ["a{2}"]),
    (r"\(ab\)*c", ["ababc", "c", "x"], ["ababc", "c"]),
    ("*a", ["*a", "a"], ["*a"]),
    ("a+", ["a+", "aa"], ["a+"]),
    (r"a\+b", ["aab", "a+b"], ["aab"]),
    ("a^b", ["a^b", "ab"], ["a^b"]),
    ("^a", ["ab", "ba"], ["ab"]),
    ("a$", ["ba", "ab", "a\n"], ["ba"]),
    ("a$b", ["a$b", "ab"], ["a$b"]),
    (r"\(a\)\1", ["aa", "ab"], ["aa"]),
    (r"a\|b", ["a", "b", "c"], ["a", "b"]),
    (r"[\n]x", ["\\x", "nx", "\nx"], ["\\x", "nx"]),
    ("[[:upper:]]b", ["Ab", "ab"], ["Ab"]),
    ("a.b", ["a\nb", "axb", "ab"], ["a\nb", "axb"]),
]
EXTENDED = [
    ("a+b?", ["aab", "b"], ["aab"]),
    ("(a|b){2}", ["ab", "a", "ba"], ["ab", "ba"]),
    ("a{,2}b", ["b", "aab"], ["b", "aab"]),
    ("a**", ["", "aa"], ["", "aa"]),
    ("a*+", ["", "aa"], ["", "aa"]),
    ("^(x|y)$", ["x", "xy", "y"], ["x", "y"]),
    (r"\.(c|h)$", ["a.c", "a.cc", "b.h"], ["a.c", "b.h"]),
    ("[]]a", ["]a", "a"], ["]a"]),
    (r"\bfoo\b", ["a foo b", "afoo"], ["a foo b"]),
]


@pytest.mark.parametrize(("pattern", "values", "expected"), BASIC)
def test_basic(spark, pattern, values, expected):
    assert hits(spark, values, pattern, regex="basic") == expected


@pytest.mark.parametrize(("pattern", "values", "expected"), EXTENDED)
def test_extended(spark, pattern, values, expected):
    assert hits(spark, values, pattern, regex="extended") == expected


@pytest.mark.parametrize(("pattern", "extended"), [("(", True), (r"\(", False), (r"\)", False), ("[a", True), ("a\\", True), ("a{3,2}", True), (r"a\{x\}", False), (r"\1", False), ("[[:nope:]]", True), ("[b-a]", True)])
def test_invalid(pattern, extended):
    with pytest.raises(PatternError):
        posix_regex(pattern, extended)


def test_required_literals():
    assert posix_regex("abc+def?g(x|y)hi", True)[1] == ["abc", "de", "g", "hi"]
    assert posix_regex("abc|def", True)[1] == []
    assert posix_regex("ab{0,2}c", True)[1] == ["a", "c"]


def trigrams(name):
    raw = name.encode()
    return {raw[i : i + 3].hex().upper() for i in range(len(raw) - 2)}


def passes(groups, name):
    have = trigrams(name)
    return all(have & g for g in groups)


TEXT = st.text(alphabet="abcXYZ/éÉİıßKkſ[]*?\\-x", max_size=12)


@settings(max_examples=300, deadline=None)
@given(TEXT, TEXT)
def test_plan_is_lossless(pattern, name):
    try:
        needle = classify(pattern)
    except PatternError:
        return
    if needle.kind == "substring":
        matched = needle.text in name
    else:
        matched = re.match(needle.text.replace("\\z", "\\Z"), name) is not None
    for hay, sure in ((name, matched), (name + unescape_or(pattern) + name, needle.kind == "substring")):
        if sure:
            assert passes(plan([needle]), hay)


def unescape_or(pattern):
    try:
        return unescape(pattern)
    except PatternError:
        return ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aké ßſiI", min_size=1, max_size=8), st.text(max_size=3))
def test_folded_plan_is_lossless(text, around):
    groups = plan([classify(text.replace("\\", ""), ignore_case=True)])
    for variant in (text, text.upper() if len(text.upper()) == len(text) else text, text.lower(), text.swapcase() if len(text.swapcase()) == len(text) else text):
        assert passes(groups, around + variant + around)


def test_plan_details():
    assert plan([classify("ab")]) == []
    assert plan([classify("a*b")]) == []
    assert len(plan([classify("abcabc")])) == 3
    assert plan([classify(r"a\\bc")]) == [frozenset([b"a\\b".hex().upper()]), frozenset([b"\\bc".hex().upper()])]
    assert plan([classify("*[[:digit:]]abc")]) == [frozenset(["616263"])]
    assert len(plan([classify("abc", ignore_case=True)])[0]) == 8
    assert shown(frozenset(["616263"])) == "(abc)"


def test_cut():
    groups = [frozenset(["A"]), frozenset(["B"]), frozenset(["C", "D"])]
    assert cut(groups, {"A": 5000, "B": 10, "C": 20, "D": 30}) == [groups[1], groups[2]]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab*?", max_size=6), st.text(alphabet="ab/", max_size=6))
def test_glob_agrees_with_fnmatch(pattern, name):
    from pathweave.functions.patterns import glob_regex

    found = re.search(glob_regex(glob_tokens(pattern)).replace("\\z", "\\Z"), name) is not None
    assert found == fnmatch.fnmatchcase(name, pattern)
