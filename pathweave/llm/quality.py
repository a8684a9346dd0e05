"""Quality rules with host verdicts, in DataFrame functions only.

Each document gets counts over its whole text and rules over the counts.  A host (the ``host`` column) is
judged by how many of its documents fail any rule: its rate is shrunk towards a beta prior whose mean and
weight come from the hosts by the method of moments, each host counting once, so that a host with few documents
needs more than a few failures and one with a third of all documents does not set the prior.  Documents of a host whose shrunk rate is above ``max_rate`` are not kept.

Repeated three-word windows are found without leaving the row: each window's hash, with its position in the
low bits, goes into one array of longs; sorted, equal hashes are neighbours; their positions, sorted again,
give the words that the windows cover.  Hashes keep 64 bits less those of the position, and neighbours that
agree are compared word by word; a window beside another one of the same hash is compared with all.

Cases: a null or empty text has no words and fails; a null host is no host, and such documents are judged by
the base rules alone; repeated rows are counted each; an empty table gives an empty table; texts are read
whole, however long; a rate of just ``max_rate`` is no ground to drop; other columns are neither used nor returned by
``judge``, so that none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, is_small, settled

BROADCAST_ROWS = 20_000
SALTS = 32


def features(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all but ``text``) with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    stay = [c for c in (df.columns if keep is None else keep) if c != text]
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    symbols = F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", ""))
    a = df.select(*stay, words.alias("_words"), lines.alias("_lines"), symbols.cast("long").alias("n_symbols"))
    w, n = F.col("_words"), F.size("_words")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1
    b = a.select(
        *stay,
        "n_symbols",
        "_words",
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        low.alias("_low"),
    )
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: i + 2 < n)
    keyed = F.transform(places, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(F.col("_low"))).bitwiseOR(i.cast("long")))
    c = b.withColumn("_keys", F.sort_array(keyed))
    k = F.col("_keys")
    mask = F.bitwise_not(F.col("_low"))

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.col("_low")).cast("int")

    def same(x: Column, y: Column) -> Column:
        equal = x.bitwiseAND(mask) == y.bitwiseAND(mask)
        for d in range(3):
            equal = equal & (F.get(w, place(x) + d) == F.get(w, place(y) + d))
        return equal

    def meets(x: Column, i: Column, test) -> Column:
        return ((i > 0) & test(x, F.get(k, i - 1))) | ((i + 1 < F.size(k)) & test(x, F.get(k, i + 1)))

    def alike(x: Column, y: Column) -> Column:
        return x.bitwiseAND(mask) == y.bitwiseAND(mask)

    def anywhere(x: Column) -> Column:
        return F.exists(k, lambda y: (y != x) & same(x, y))

    twice = F.filter(k, lambda x, i: meets(x, i, same) | (meets(x, i, alike) & anywhere(x)))
    d = c.withColumn("_at", F.sort_array(F.transform(twice, place)))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("_at", start, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")), lambda s: s["n"])
    return d.select(*stay, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered.alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def any_failed() -> Column:
    """Whether a document counts against its host."""
    odd_words = (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))
    return base_failed() | odd_words | (10 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))


def host_rates(counted: DataFrame, host: str = "host") -> DataFrame:
    """One row for each host that is not null: ``host``, ``n_docs``, ``n_failed``, ``rate`` (shrunk)."""
    hosts = counted.filter(F.col(host).isNotNull()).groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(any_failed().cast("long")).alias("n_failed"))
    hosts = settled(hosts, "hosts")
    p = F.col("n_failed") / F.col("n_docs")
    s = hosts.agg(F.count("*").alias("h"), F.avg(p).alias("mean"), F.avg(p * p).alias("square"), F.avg(1 / F.col("n_docs")).alias("inverse")).first()
    if not s["h"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = s["mean"]
    between = max(0.0, s["square"] - mean * mean)  # the variance of the rates
    within = mean * (1 - mean) * s["inverse"]  # what chance alone would make of it
    weight = min(1e6, max(2.0, mean * (1 - mean) / (between - within) - 1)) if between > within else 1e6 if mean in (0.0, 1.0) or s["h"] > 1 else 2.0
    return hosts.withColumn("rate", (F.col("n_failed") + mean * weight) / (F.col("n_docs") + weight))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``key``, the counts, ``base_failed``, ``host_rate`` and ``kept`` for each row of ``df``."""
    chosen = df.select(F.col(key).alias("_key"), F.col(host).alias("host"), F.col(text).alias("text"))
    counted = settled(features(chosen, "text"), "features")
    hosts = settled(host_rates(counted).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate")), "rates")
    if is_small(hosts, BROADCAST_ROWS):
        joined = counted.join(F.broadcast(hosts), F.col("host") == F.col("_host"), "left")
    else:  # a host may hold a third of all rows: its rows go to SALTS places, and its verdict to each
        left = counted.withColumn("_salt", F.pmod(F.xxhash64("_key", "word_chars"), F.lit(SALTS)).cast("int"))
        right = hosts.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_to")), "left")
    bad = F.coalesce(F.col("host_rate") > max_rate, F.lit(False))
    return joined.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))
