"""Byte-level BPE with a sentencepiece model that is serialised from a rank file.

The rank file (base64 token, rank) becomes a sentencepiece ``ModelProto``: every token's bytes are mapped to
printable code points, one for one, and the piece's score is its negative rank, so that sentencepiece's
"best score first, leftmost first" merges are the "lowest rank first" merges of the rank file.  The
normaliser is the identity and adds, drops and escapes nothing.  A text is cut by the pattern into
pre-tokens; each is looked up whole and otherwise encoded by the model.  Decoding takes the model's pieces of the
ids and maps their code points back to bytes.  No vocabulary is trained or copied: the path is a parameter.

Cases: a null text is an empty one and has no ids; a text of any length is taken whole; equal texts have
equal ids, ties and repeated rows too; an empty table gives an empty table; other columns pass through, and a column that the
operator adds replaces one of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, python_ready, release

#: Pre-tokens that a worker remembers; beyond, it starts anew.
REMEMBERED = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def byte_map() -> list[str]:
    """A printable code point for each byte: itself where it is one, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece 0 is the unknown piece and piece i + 1 is the token of the i-th lowest rank."""
    shown = byte_map()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(shown[b] for b in token).encode()) + _field(2, float(-rank)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(24, 0) + _field(35, 0)
    trainer += _field(40, 0) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))  # no BOS, EOS, PAD
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encodes texts to ids, packed as little-endian unsigned 32-bit integers, and decodes them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import sentencepiece

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.by_rank = sorted(ranks.values())
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        self.shown = byte_map()
        back = {c: b for b, c in enumerate(self.shown)}
        self.tokens = {rank: bytes([back[c] for c in self.model.id_to_piece(i + 1)]) for i, rank in enumerate(self.by_rank)}
        self.known: dict[str, bytes] = {}

    def _pack(self, part: str) -> bytes:
        raw = part.encode()
        if (whole := self.ranks.get(raw)) is not None:
            ids = [whole]
        else:
            shown = self.shown
            ids = [self.by_rank[i - 1] for i in self.model.encode("".join([shown[b] for b in raw]))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(part) <= 64:
            self.known[part] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        known, pack, out = self.known, self._pack, []
        for part in self.find(text or ""):
            out.append(known.get(part) or pack(part))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """One codec for each worker process."""
    return ByteBpe(read_ranks(path), pattern)


def _extended(df: DataFrame, added: list[tuple[str, T.DataType]], work, keep: list[str] | None = None) -> DataFrame:
    """Arrow batches of ``df`` through ``work(batch) -> list of arrays``; the columns ``keep`` (all) stay."""
    python_ready(df.sparkSession)
    names = [n for n, _ in added]
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in {n.lower() for n in names}]
    fields = [*[df.schema[c] for c in stay], *[T.StructField(n, t) for n, t in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arrays = [b.column(c) for c in stay]
            yield pa.RecordBatch.from_arrays([*arrays, *work(b)], names=[*stay, *names])
        release()

    return in_arrow(df, run, T.StructType(fields))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", digests: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of long) and ``n_tokens``; with ``digests`` also the SHA-256 of the packed ids and of the decoded bytes."""
    added = [(ids, T.ArrayType(T.LongType(), False)), ("n_tokens", T.LongType())]
    if digests:
        added += [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path, pattern)
        packed = [c.encode(t) for t in b.column(text).to_pylist()]
        offsets = [0]
        for p in packed:
            offsets.append(offsets[-1] + len(p) // 4)
        flat = pa.Array.from_buffers(pa.uint32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))]).cast(pa.int64())
        out = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), pa.array([len(p) // 4 for p in packed], pa.int64())]
        return out + (_digests(c, packed) if digests else [])

    return _extended(df, added, work, keep)


def _digests(c: ByteBpe, packed: list[bytes]) -> list[pa.Array]:
    sha = hashlib.sha256
    return [pa.array([sha(p).hexdigest() for p in packed], pa.string()), pa.array([sha(c.decode(p)).hexdigest() for p in packed], pa.string())]


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (binary): the bytes of the tokens in ``ids``; null ids give no bytes."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        tokens = codec(path, pattern).tokens
        return [pa.array([b"".join([tokens[i] for i in x or ()]) for x in b.column(ids).to_pylist()], pa.binary())]

    return _extended(df, [(out, T.BinaryType())], work)


def digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens`` and both digests of each row: what ``encode`` then ``decode`` give, without the ids leaving the worker."""

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path, pattern)
        packed = [c.encode(t) for t in b.column(text).to_pylist()]
        return [pa.array([len(p) // 4 for p in packed], pa.int64()), *_digests(c, packed)]

    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return _extended(df.select(key, text), added, work, keep=[key])
