"""Media columns in the Ogg container: a multiplexer, a reader that checks it, and features of what was read.

The writer stores unsigned 8-bit mono PCM as one logical stream and the number of meaningful bytes as a second one. The
reader verifies every page's checksum and sequence number, reassembles packets from lacing values (also across pages),
demultiplexes the logical streams by serial number, and derives each packet's time from the granule positions.

Defined cases: a null or empty text is one frame of padding; null ids stay; repeated rows are stored each for itself;
an empty table gives an empty table; other columns are ignored; long texts span as many pages as they need.
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

from .common import bound_arrow, slices

FRAME = 192
RATE = 8000
PACKET = 16 * FRAME
AUDIO, NOTE = 0x0A0D10, 0x0B0E20
CONTINUED, FIRST, LAST = 1, 2, 4
#: An Ogg page header up to the lacing table: magic, version, flags, granule, serial, sequence, checksum, segments.
PAGE = struct.Struct("<4sBBqIIIB")
#: Identification packet of raw PCM: magic, version, sample format (unsigned 8 bit), rate, bits, channels, frames a packet, extra headers.
PCM = struct.Struct(">8sHHIIBBHI")
FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """Ogg's CRC-32 (polynomial 04C11DB7, most significant bit first, no inversion), by way of the reflected CRC of flipped bytes."""
    reflected = zlib.crc32(data.translate(FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(FLIP), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = PAGE.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lace(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def data_pages(payload: bytes, serial: int, sequence: int) -> Iterator[bytes]:
    """Pages of a stream whose packets are the payload in pieces of PACKET bytes; granule positions count bytes."""
    total = len(payload)
    full, rest = divmod(total, PACKET)
    lacing = lace(PACKET) * full + (lace(rest) if rest else b"")
    at, flags = 0, 0
    for i in range(0, len(lacing), 255):
        part = lacing[i : i + 255]
        size = sum(part)
        # packets that end on this page: all but the last are PACKET long
        done = total if i + 255 >= len(lacing) else (at + size) // PACKET * PACKET
        granule = done if done > at or part[-1] < 255 else -1
        yield page(flags | (LAST if i + 255 >= len(lacing) else 0), granule, serial, sequence, part, payload[at : at + size])
        at, sequence = at + size, sequence + 1
        flags = CONTINUED if part[-1] == 255 else 0


def encode(text: bytes) -> bytes:
    """One document as Ogg: padded with spaces to whole frames, its true length in a stream beside it."""
    payload = text + b" " * (-len(text) % FRAME if text else FRAME)
    ident = PCM.pack(b"PCM     ", 0, 0, 1, RATE, 8, 1, PACKET, 0)
    note = b"LEN " + struct.pack("<Q", len(text))
    out = [page(FIRST, 0, AUDIO, 0, lace(len(ident)), ident), page(FIRST | LAST, 0, NOTE, 0, lace(len(note)), note)]
    out.extend(data_pages(payload, AUDIO, 1))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets, each with the granule position at its end (-1: not known), and what is still open."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    open: list[bytes] = field(default_factory=list)
    sequence: int = 0
    ended: bool = False


class OggError(ValueError):
    """The bytes are not a sound Ogg file."""


def demux(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number. Raises OggError for a bad checksum, gap, or broken packet."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if at + PAGE.size > len(media):
            raise OggError("a page is cut off")
        magic, version, flags, granule, serial, sequence, crc, count = PAGE.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one should start")
        body = at + PAGE.size + count
        lacing = media[at + PAGE.size : body]
        end = body + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("a page is cut off")
        if checksum(media[at : at + 22] + bytes(4) + media[at + 26 : end]) != crc:
            raise OggError("a page's checksum is wrong")
        if flags & FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Stream()
        stream = streams.get(serial)
        if stream is None or stream.sequence != sequence or stream.ended:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != bool(stream.open):
            raise OggError("a continued packet has no start, or a started one no end")
        done = len(stream.packets)
        pos = body
        start = pos
        for size in lacing:
            pos += size
            if size < 255:
                stream.packets.append(b"".join([*stream.open, media[start:pos]]) if stream.open else media[start:pos])
                stream.granules.append(-1)
                stream.open = []
                start = pos
        if start < pos or lacing and lacing[-1] == 255:
            stream.open.append(media[start:pos])
        if len(stream.packets) > done:
            stream.granules[-1] = granule
        stream.sequence += 1
        stream.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


def times(stream: Stream, rate: int) -> list[tuple[float, float]]:
    """Start and end in seconds of every data packet; ends inside a page are counted back from the page's granule position."""
    out: list[tuple[float, float]] = []
    end = -1
    for packet, granule in zip(reversed(stream.packets[1:]), reversed(stream.granules[1:]), strict=True):
        end = granule if granule >= 0 else end
        if end < 0:
            raise OggError("a page on which packets end has no granule position")
        out.append(((end - len(packet)) / rate, end / rate))
        end -= len(packet)
    return out[::-1]


def features(media: bytes) -> tuple[int, bytes, str]:
    """Meaningful bytes, payload and features: packets, seconds, mean, deviation and sign changes of the samples."""
    streams = demux(media)
    audio, note = streams[AUDIO], streams[NOTE]
    ident = PCM.unpack(audio.packets[0])
    if ident[0] != b"PCM     " or ident[3] != 1 or note.packets[0][:4] != b"LEN ":
        raise OggError("not 8-bit PCM with its length")
    (length,) = struct.unpack("<Q", note.packets[0][4:])
    spans = times(audio, ident[4])
    if spans[0][0] != 0 or any(a[1] != b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise OggError("granule positions leave a gap")
    payload = b"".join(audio.packets[1:])
    counts, changes, last = np.zeros(256, np.int64), 0, None
    for i in range(0, len(payload), 1 << 20):
        part = np.frombuffer(payload, np.uint8, min(1 << 20, len(payload) - i), i)
        counts += np.bincount(part, minlength=256)
        high = part >= 128
        changes += int(np.count_nonzero(high[1:] != high[:-1])) + (last is not None and bool(high[0]) != last)
        last = bool(high[-1])
    levels = np.arange(256) - 128
    mean = int((counts * levels).sum()) / len(payload)
    power = int((counts * levels * levels).sum()) / len(payload)
    return length, payload, f"packets={len(spans)};seconds={spans[-1][1]:.6f};mean={mean:.4f};rms={power**0.5:.4f};changes={changes}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and media (binary): every text as an Ogg file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                texts = part.column("_text").to_pylist()
                media = pa.array([encode(t or b"") for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("_id"), media], ["_id", "media"])

    bound_arrow(docs.sparkSession)
    source = docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS _text")
    return source.mapInArrow(run, f"_id {kind}, media binary").withColumnRenamed("_id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the media column back: sizes, checksums and features of every file."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("media"):
                m = value.as_py()
                n, payload, feature = features(m)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], ["_id", *names])

    bound_arrow(media.sparkSession)
    schema = f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.selectExpr(f"`{id_col}` AS _id", "media").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
