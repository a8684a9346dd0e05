"""Media columns: Ogg containers in binary columns.

``mux`` lays packets of several logical streams into pages: lacing values of 255 and a last one below it,
packets that go on in the next page, granule positions, sequence numbers and page checksums.  ``demux``
verifies every page's checksum, sorts the pages by serial number, reassembles the packets from the lacing
values and derives each packet's time from the granule positions: a page names the position at the end of
the last packet that it completes, and packets before that one end earlier by the samples that follow them.

The checksum is CRC-32 with polynomial 0x04C11DB7, most significant bit first, without inversion.  It is
taken from zlib's CRC, which runs the other way, by reversing the bits of each byte and of the result.

``encode`` stores each text as one container: stream 1 has a header and the UTF-8 bytes, padded with zeros to
a positive multiple of 64, as unsigned 8-bit samples; stream 2 names the length without the padding.
``features`` reads stored containers and never sees the text.

Cases: a null text is an empty one (64 zero samples); a text of any length is stored whole; equal texts have
equal containers, repeated rows too; a damaged, truncated or null container gives nulls and a message in ``error``; an empty
table gives an empty table; other columns pass, but for those named like what is added, which are replaced.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import in_arrow, python_ready, settled

CONTINUED, FIRST, LAST = 1, 2, 4
RATE = 8000
PACKET = 16384  #: samples in a packet
PAD = 64
SAMPLES, LENGTH = 1, 2  #: serial numbers of the two streams
_HEADER = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def checksum(page: bytes) -> int:
    """The page checksum, over a page whose checksum field is zero."""
    r = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing))
    page = head + lacing + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one stream; its first packet has the first page alone."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def close(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(_page(flags | (LAST if last else 0), granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for k, (packet, position) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = begun = 0
        while at < len(values):
            if len(lacing) == 255:
                close(False)
                flags = CONTINUED if at else 0
            n = min(255 - len(lacing), len(values) - at)
            size = sum(values[at : at + n])
            lacing += values[at : at + n]
            body.append(packet[begun : begun + size])
            at, begun = at + n, begun + size
        granule = position
        if k == 0 or k == len(packets) - 1:
            close(k == len(packets) - 1)
    return pages


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One container from, for each serial number, the packets with the positions at their ends.

    First pages come first, as the format asks; the other pages take turns."""
    each = [_stream(serial, packets) for serial, packets in sorted(streams.items()) if packets]
    turns = range(max(map(len, each), default=0))
    return b"".join(pages[i] for i in turns for pages in each if i < len(pages))


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  #: granule position at each packet's end; -1 if the pages don't tell
    pages: int = 0
    ended: bool = False
    _open: list[bytes] | None = None

    def times(self, rate: int = RATE) -> list[float]:
        return [e / rate if e >= 0 else -1.0 for e in self.ends]


def demux(data: bytes, samples=len) -> dict[int, Stream]:
    """The streams of a container by serial number.  ``samples``: how many samples a packet has."""
    found: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < _HEADER.size:
            raise OggError(f"a page header ends early at byte {at}")
        magic, version, flags, granule, serial, number, crc, n = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = data[at + _HEADER.size : at + _HEADER.size + n]
        begin = at + _HEADER.size + n
        end = begin + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError(f"the page at byte {at} ends early")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"the page at byte {at} has a wrong checksum")
        s = found.setdefault(serial, Stream())
        if s.pages != number or bool(flags & FIRST) != (number == 0) or s.ended:
            raise OggError(f"the page at byte {at} is out of order in stream {serial}")
        if bool(flags & CONTINUED) != (s._open is not None):
            raise OggError(f"a packet of stream {serial} is broken off before byte {at}")
        parts, s._open = s._open or [], None
        done: list[bytes] = []
        begun, size, runs = begin, 0, False
        for value in lacing:
            size += value
            runs = value == 255
            if not runs:
                done.append(b"".join([*parts, data[begun : begun + size]]))
                parts, begun, size = [], begun + size, 0
        if runs:
            s._open = [*parts, data[begun : begun + size]]
        if done:
            ends, position = [], granule
            for packet in reversed(done):
                ends.append(position)
                position = position - samples(packet) if position >= 0 else -1
            s.ends += ends[::-1]
        elif granule != -1:
            raise OggError(f"the page at byte {at} names a position but ends no packet")
        s.packets += done
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        at = end
    if any(s._open is not None or not s.ended for s in found.values()):
        raise OggError("the container ends early")
    return found


def store(raw: bytes) -> bytes:
    """The container of a byte string."""
    padded = raw + bytes((-len(raw)) % PAD or (0 if raw else PAD))
    sound = [(struct.pack("<8sIIQ", b"PCM-U8\0\0", RATE, 1, len(padded)), 0)]
    sound += [(padded[i : i + PACKET], min(i + PACKET, len(padded))) for i in range(0, len(padded), PACKET)]
    length = [(b"LENGTH\0\0", 0), (struct.pack("<Q", len(raw)), len(padded))]
    return mux({SAMPLES: sound, LENGTH: length})


def read(media: bytes) -> tuple[bytes, int, dict[int, Stream]]:
    """The payload with its padding, the length without it, and the streams."""
    streams = demux(media)
    if set(streams) != {SAMPLES, LENGTH}:
        raise OggError("the streams are not those of a stored text")
    head, *packets = streams[SAMPLES].packets
    magic, _, _, n = struct.unpack("<8sIIQ", head)
    payload = b"".join(packets)
    (length,) = struct.unpack("<Q", streams[LENGTH].packets[1])
    if magic != b"PCM-U8\0\0" or n != len(payload) or streams[SAMPLES].ends[-1] != n or not 0 <= length <= n:
        raise OggError("the samples are not complete")
    return payload, length, streams


def encode(df: DataFrame, text: str = "text", out: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Add the binary column ``out`` with each text's container to the columns ``keep`` (all)."""
    python_ready(df.sparkSession)
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = pa.array([store((t or "").encode("utf-8", "surrogatepass")) for t in b.column(text).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], media], names=[*stay, out])

    return in_arrow(df, run, T.StructType([*[df.schema[c] for c in stay], T.StructField(out, T.BinaryType())]))


_ADDED = [("n_bytes", T.LongType(), pa.int64()), ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()), ("feature", T.StringType(), pa.string()), ("error", T.StringType(), pa.string())]


def describe(media: bytes | None) -> tuple:
    """What ``features`` returns for one container."""
    if media is None:
        return (None,) * 7 + ("no container",)
    try:
        payload, n, streams = read(media)
    except (OggError, struct.error, ValueError, IndexError) as e:
        return (None, None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, str(e))
    x = np.frombuffer(payload, np.uint8)
    sound = streams[SAMPLES]
    feature = f"streams={len(streams)} pages={sum(s.pages for s in streams.values())} packets={len(sound.packets) - 1} seconds={sound.times()[-1]:.6f} low={x.min()} high={x.max()} sum={int(x.sum(dtype=np.int64))}"
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature, None


def features(df: DataFrame, media: str = "media", keep: list[str] | None = None) -> DataFrame:
    """Demultiplex the containers in ``media`` and describe what they hold; ``keep``: other columns that stay (all)."""
    python_ready(df.sparkSession)
    names = [n for n, _, _ in _ADDED]
    stay = [c for c in (df.columns if keep is None else keep) if c.lower() not in {*names, media.lower()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*[describe(m) for m in b.column(media).to_pylist()], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in stay], *[pa.array(v, t) for v, (_, _, t) in zip(found, _ADDED, strict=True)]], names=[*stay, *names])

    return in_arrow(df, run, T.StructType([*[df.schema[c] for c in stay], *[T.StructField(n, t) for n, t, _ in _ADDED]]))


def stored_features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store the texts of ``df`` as a table of containers in the shared folder, read it back and describe each."""
    return features(settled(encode(df.select(key, text), text, keep=[key]), "media"))
