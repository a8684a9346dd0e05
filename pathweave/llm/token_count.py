"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each position of a text; dynamic
programming carries, for each position, the score of the best segmentation up to it and its number of
pieces.  No segmentation is built.  The tie rules are those of sentencepiece's unigram model: candidates for
an end are taken in the order of their starts and only a strictly better one replaces; a code point that is
no piece of its own may be an unknown, at the lowest score less 10, and with byte fallback it counts as many
pieces as it has UTF-8 bytes.  White space is kept, a space becomes U+2581 and one is put before a text.

The text is cut before each run of spaces and around code points that occur in no piece.  No piece lies
across such a cut (checked when the vocabulary is read; a vocabulary with such pieces is not cut at spaces),
so the parts' best segmentations make up the text's, and a worker remembers the counts of parts.

Scores are those of the model's file, as doubles: sums of ranks up to 2 ** 53 are exact, so ties are ties.  A file of a
BPE model gives ranks for scores; what is counted then is the best segmentation under these scores, not the
pieces that the BPE merges would leave.

Cases: a null text is an empty one and has 0 tokens; texts are counted whole, whatever their length; equal
texts, and repeated rows, have equal counts; ties in score go to the segmentation that the tokenizer takes; an empty table
gives an empty table; other columns pass through, but for one named like ``out``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, python_ready

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 100_000


class Vocabulary:
    """Pieces with scores, and whether unknown code points fall back to bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool):
        import ahocorasick

        self.scores: dict[str, float] = {}
        for piece, score in pieces:
            self.scores.setdefault(piece, score)
        self.byte_fallback = byte_fallback
        self.unknown = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.letters = {c for p in self.scores for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.scores)
        no_piece = "".join(c for c in "\n\r\t" if c not in self.letters)
        class_ = re.escape(no_piece)
        self.cut = re.compile(f"[{class_}]+|[^{class_}]+" if inner and no_piece else ".+" if inner else f" +[^ {class_}]*|[^ {class_}]+" + (f"|[{class_}]" if no_piece else ""), re.DOTALL).findall
        self.known: dict[str, int] = {}

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The normal pieces of a model file with the scores that it gives them."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        normal = [(m.id_to_piece(i), m.get_score(i)) for i in ids if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]
        return cls(normal, any(m.is_byte(i) for i in ids))

    def viterbi(self, part: str) -> tuple[float, int]:
        """Best score and number of pieces of a string in which spaces are U+2581 already."""
        n = len(part)
        best, count, at = [0.0] * (n + 1), [0] * (n + 1), 0
        reached = [True] + [False] * n
        scores, unknown = self.scores, self.unknown

        def alone(upto: int, at: int) -> int:
            """Close the positions up to ``upto``: where a code point is no piece, it may be unknown."""
            while at < upto:
                c = part[at]
                if c not in scores:
                    s = best[at] + unknown
                    if not reached[at + 1] or s > best[at + 1]:
                        best[at + 1], count[at + 1] = s, count[at] + (len(c.encode()) if self.byte_fallback else 1)
                        reached[at + 1] = True
                at += 1
            return at

        for last, (length, score) in self.automaton.iter(part):
            end = last + 1
            if at < last:
                at = alone(last, at)
            start = end - length
            s = best[start] + score
            if not reached[end] or s > best[end]:
                best[end], count[end], reached[end] = s, count[start] + 1, True
        alone(n, at)
        return best[n], count[n]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for part in self.cut(" " + text.replace(SPACE, " ")):  # the tokenizer takes both for the same
            n = known.get(part)
            if n is None:
                n = self.viterbi(part.replace(" ", SPACE))[1]
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(part) <= 64:
                    known[part] = n
            total += n
        return total


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary.from_sentencepiece(path)


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """Add ``out``, the number of tokens of ``text``, to the columns ``keep`` (all)."""
    python_ready(df.sparkSession)
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    fields = [*[df.schema[c] for c in stay], T.StructField(out, T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = vocabulary(path).count
        for b in batches:
            found = pa.array([count(t) for t in b.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], found], names=[*stay, out])

    return in_arrow(df, run, T.StructType(fields))
