"""Language identification with bit-sliced Bloom filters.

A text is lower-cased, everything that is not a letter counts as a space, and its character n-grams are the
three code points around each letter.  Training keeps, for each language, the n-grams that are about as
frequent there as anywhere, and puts them into one Bloom filter per language.  The filters share their hash
functions and are stored sliced: slot s is a bit mask with one bit per language, so that AND-ing the slots
of an n-gram returns all languages that contain it.  A text's languages are counted by the bits of its
n-grams' masks; each count is corrected for the false positives of that language's filter (its fill to the
power of the number of hash functions), and the largest corrected count decides.

The n-gram statistics come from a bounded sample: about ``Settings.docs_per_language`` documents of each
language, chosen by a hash of the key, so that it is the same in each run.  Prediction covers every row.

Cases: a null text, an empty one and one without a letter give ``und`` and score 0; ties go to the language
that is first by code point; a text whose n-grams are all unknown gets the most frequent language with
score 0; without any labelled row all predictions are ``und``; a null key counts as an empty key; equal texts, and repeated
rows, have equal results; long texts are read whole, in blocks; an empty table gives an empty table; other columns
pass ``predict`` but for those named like its results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, python_ready

UNKNOWN = "und"
#: Code points that one numpy pass takes; longer texts are read in overlapping blocks.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 2000  #: bound of the training sample, for each language
    grams_per_language: int = 12000
    least_count: int = 3
    ratio: float = 3.0  #: an n-gram is a language's if nowhere more than so many times as frequent
    slots: int = 1 << 18
    hashes: int = 3


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Packed n-grams (3 times 21 bits), block by block; each letter is the middle of one."""
    letters = _letters()
    for at in range(0, len(codes), BLOCK):
        part = codes[max(0, at - 1) : at + BLOCK + 1]
        is_letter = letters[part]
        shown = np.where(is_letter, part, 32).astype(np.uint64)
        if at == 0:
            shown, is_letter = np.concatenate(([np.uint64(32)], shown)), np.concatenate(([False], is_letter))
        if at + BLOCK >= len(codes):
            shown, is_letter = np.concatenate((shown, [np.uint64(32)])), np.concatenate((is_letter, [False]))
        packed = shown[:-2] << np.uint64(42) | shown[1:-1] << np.uint64(21) | shown[2:]
        yield packed[is_letter[1:-1]]


def grams(text: str | None) -> np.ndarray:
    """All packed n-grams of a text."""
    return np.concatenate([np.empty(0, np.uint64), *_blocks(code_points(text or ""))])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


@dataclass
class Filters:
    """The sliced filters: ``planes[p]`` has a byte for each slot, with the languages 8p to 8p + 7."""

    languages: list[str]
    planes: np.ndarray
    hashes: int
    usual: int  #: the most frequent language
    wrong: np.ndarray = field(default=None)  #: for each language, the probability of a false positive

    def __post_init__(self):
        bits = np.unpackbits(self.planes, axis=1, bitorder="little") if len(self.planes) else None
        n, slots = len(self.languages), self.planes.shape[1]
        fill = [np.count_nonzero(self.planes[i >> 3] & (1 << (i & 7))) / slots for i in range(n)]
        del bits
        self.wrong = np.array(fill) ** self.hashes
        self.bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)

    def slots(self, packed: np.ndarray) -> list[np.ndarray]:
        h = _mixed(packed)
        step, mask = h >> np.uint64(32) | np.uint64(1), np.uint64(self.planes.shape[1] - 1)
        return [((h + np.uint64(i) * step) & mask).astype(np.int64) for i in range(self.hashes)]

    def add(self, language: int, packed: np.ndarray) -> None:
        for s in self.slots(packed):
            self.planes[language >> 3, s] |= np.uint8(1 << (language & 7))

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams, and each language's popcount."""
        total, found = 0, np.zeros(len(self.planes) * 8, np.int64)
        for packed in _blocks(code_points(text)):
            total += len(packed)
            where = self.slots(packed)
            for p, plane in enumerate(self.planes):
                masks = plane[where[0]]
                for s in where[1:]:
                    masks &= plane[s]
                found[p * 8 : p * 8 + 8] += np.bincount(masks, minlength=256) @ self.bits
        return total, found[: len(self.languages)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float]:
        """The language, its share of all languages' corrected counts, and the share of the text's n-grams that are its own.

        The last does not depend on the number of languages."""
        if not text or not self.languages:
            return UNKNOWN, 0.0, 0.0
        total, found = self.counts(text)
        if not total:
            return UNKNOWN, 0.0, 0.0
        right = np.maximum(0.0, (found - total * self.wrong) / (1 - self.wrong))
        if not right.any():
            return self.languages[self.usual], 0.0, 0.0
        best = int(right.argmax())
        return self.languages[best], float(right[best] / right.sum()), float(right[best] / total)


def key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def is_held_out(key: str = "doc_id") -> Column:
    return F.crc32(key_text(key)) % 4 == 2


def fit(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings | None = None) -> Filters:
    """Filters from the rows of ``df`` where ``train`` holds and text and language are not null."""
    s = settings or Settings()
    rows = df.filter(train & F.col(lang).isNotNull())
    seen = {r[0]: r[1] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # one row for each language
    languages = sorted(seen, key=lambda x: x.encode())
    planes = np.zeros((max(1, -(-len(languages) // 8)), s.slots), np.uint8)
    usual = max(range(len(languages)), key=lambda i: seen[languages[i]], default=0)
    if not languages:
        return Filters([], planes, s.hashes, usual)
    share = F.create_map(*[F.lit(x) for i in languages for x in (i, min(1.0, s.docs_per_language / seen[i]))])
    drawn = F.pmod(F.xxhash64(key_text(key), F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(F.col(text).isNotNull() & (drawn < share[F.col(lang)])).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    python_ready(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            for l in sorted(set(langs)):
                packed, n = np.unique(np.concatenate([grams(t) for x, t in zip(langs, texts, strict=True) if x == l]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([l] * len(n), pa.string()), pa.array(packed.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    everywhere = Window.partitionBy("lang")
    share_of = counts.withColumn("f", F.col("n") / F.sum("n").over(everywhere)).filter(F.col("n") >= s.least_count)
    own = share_of.withColumn("most", F.max("f").over(Window.partitionBy("gram"))).filter(F.col("f") * s.ratio >= F.col("most"))
    best = own.withColumn("rank", F.row_number().over(everywhere.orderBy(F.desc("f"), "gram"))).filter(F.col("rank") <= s.grams_per_language)
    filters = Filters(languages, planes, s.hashes, usual)
    chosen: dict[str, list[int]] = {}
    for r in best.select("lang", "gram").collect():  # at most grams_per_language for each language
        chosen.setdefault(r[0], []).append(r[1])
    for i, l in enumerate(languages):
        filters.add(i, np.array(chosen.get(l, []), np.int64).view(np.uint64))
    return Filters(languages, filters.planes, s.hashes, usual)


def predict(df: DataFrame, filters: Filters, text: str = "text", keep: list[str] | None = None, share: str | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add ``out`` (language and score) and, if ``share`` names it, the share of n-grams known to the columns ``keep`` (all)."""
    spark = df.sparkSession
    python_ready(spark)
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in {str(x).lower() for x in (*out, share)}]
    fields = [*[df.schema[c] for c in stay], T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), *([T.StructField(share, T.DoubleType())] if share else [])]
    names = [f.name for f in fields]
    shared = spark.sparkContext.broadcast(filters)  # its size is fixed by Settings.slots and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            found = [f.judge(t) for t in b.column(text).to_pylist()]
            known = [pa.array([x[2] for x in found], pa.float64())] if share else []
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), *known], names=names)

    return in_arrow(df, run, T.StructType(fields))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings | None = None) -> DataFrame:
    """Learn from the rows that are not held out, predict all: ``key``, ``held_out``, ``lang_pred``, ``score``."""
    filters = fit(df, ~is_held_out(key), key, text, lang, settings)
    found = predict(df.select(key, text), filters, text, keep=[key])
    return found.select(key, is_held_out(key).alias("held_out"), "lang_pred", "score")
