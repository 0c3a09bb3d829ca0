"""Ogg media columns: pages with checksums, packets by lacing values, logical streams, granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import arrow_udf, frugal, strings, structs

#: Fixed values of the page format (RFC 3533).
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
MOST_SEGMENTS = 255
#: Unsigned 8-bit samples: of a packet, and a second.
FRAME = 576
RATE = 8000

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, from 0: zlib's turns bits round and inverts both ends."""
    mirrored = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    offset: int = 0

    def packed(self) -> bytes:
        head = HEADER.pack(CAPTURE, 0, self.flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + self.lacing
        crc = page_crc(head + self.body)
        return head[:22] + struct.pack("<I", crc) + head[26:] + self.body


def read_pages(media: bytes) -> Iterator[Page]:
    """All pages, in order. A wrong capture pattern, a cut page or a wrong checksum raises OggError."""
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError(f"cut header at byte {at}")
        capture, version, flags, granule, serial, sequence, crc, n = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        start = at + HEADER.size + n
        lacing = media[at + HEADER.size : start]
        end = start + sum(lacing)
        if len(lacing) < n or end > len(media):
            raise OggError(f"cut page at byte {at}")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        yield Page(flags, granule, serial, sequence, lacing, media[start:end], at)
        at = end


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets that ended by then) of each page that ends a packet.
    marks: list[tuple[int, int]] = field(default_factory=list)
    n_pages: int = 0
    first: bool = False
    last: bool = False
    _open: bytes | None = None

    def take(self, page: Page) -> None:
        if page.sequence != self.n_pages:
            raise OggError(f"stream {self.serial}: page {page.sequence} where {self.n_pages} is due")
        if bool(page.flags & CONTINUED) != (self._open is not None):
            raise OggError(f"stream {self.serial}: page {page.sequence} does not carry on the packet before")
        if self.last:
            raise OggError(f"stream {self.serial}: a page after the last")
        self.n_pages += 1
        self.first |= bool(page.flags & FIRST)
        self.last |= bool(page.flags & LAST)
        at, start, before = 0, 0, len(self.packets)
        for value in page.lacing:
            at += value
            if value < 255:
                self.packets.append((self._open or b"") + page.body[start:at])
                self._open, start = None, at
        if start < at or (page.lacing and page.lacing[-1] == 255):
            self._open = (self._open or b"") + page.body[start:at]
        if len(self.packets) > before:
            self.marks.append((page.granule, len(self.packets)))

    def timestamps(self, rate: int) -> list[float]:
        """Seconds at which the last packet of each page ends, where the page has a position."""
        return [granule / rate for granule, _ in self.marks if granule >= 0]


def demultiplex(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, in order of their first pages; interleaved pages are told apart by it."""
    streams: dict[int, Stream] = {}
    for page in read_pages(media):
        if page.serial not in streams and not page.flags & FIRST:
            raise OggError(f"stream {page.serial} lacks its first page")
        streams.setdefault(page.serial, Stream(page.serial)).take(page)
    for stream in streams.values():
        if stream._open is not None:
            raise OggError(f"stream {stream.serial}: the last packet is cut")
    return streams


def write_pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """A logical stream of (packet, granule position at its end). The first packet has the first page to itself."""
    pages: list[bytes] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, FIRST

    def flush(more: int) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(Page(flags | more, granule, serial, len(pages), bytes(lacing), bytes(body)).packed())
        lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    for k, (packet, position) in enumerate(packets):
        if k == 1:
            flush(0)
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            if len(lacing) == MOST_SEGMENTS:
                flush(0)
                flags = CONTINUED if at else 0
            part, values = values[: MOST_SEGMENTS - len(lacing)], values[MOST_SEGMENTS - len(lacing) :]
            size = sum(part)
            lacing += part
            body += packet[at : at + size]
            at += size
        granule = position
    flush(LAST)
    return pages


#: Fixed first bytes of our two streams' head packets: name, then rate, channels, bits, samples of a packet. The sample stream
#: has packets of samples; the level stream, for each LEVEL_SAMPLES of these, one of the least, greatest and summed sample.
HEAD = struct.Struct("<8sIBBH")
NAME, LEVELS = b"PCM8    ", b"LEVEL8  "
LEVEL = struct.Struct("<BBI")
LEVEL_SAMPLES = 32 * FRAME


def levels_of(samples: bytes) -> list[bytes]:
    parts = (np.frombuffer(samples, np.uint8, min(LEVEL_SAMPLES, len(samples) - at), at) for at in range(0, len(samples), LEVEL_SAMPLES))
    return [LEVEL.pack(int(p.min()), int(p.max()), int(p.sum())) for p in parts]


def mux_samples(payload: bytes, serial: int, rate: int = RATE, frame: int = FRAME) -> bytes:
    """Two streams: one of samples, in packets of `frame` (the last may be shorter), and one of their levels, of the next serial
    number. A position counts samples; pages lie in the order of their positions, first pages first."""
    ends = lambda step: [min(at + step, len(payload)) for at in range(0, len(payload), step)]
    sounds = [(HEAD.pack(NAME, rate, 1, 8, frame), 0), *((payload[end - 1 - (end - 1) % frame : end], end) for end in ends(frame))]
    marks = [(HEAD.pack(LEVELS, rate, 1, 8, LEVEL.size), 0), *zip(levels_of(payload), ends(LEVEL_SAMPLES), strict=True)]
    pages = [*enumerate(write_pages(sounds, serial)), *enumerate(write_pages(marks, serial + 1 & 0xFFFFFFFF))]
    place = lambda page: (page[0] > 0, HEADER.unpack_from(page[1])[3])
    return b"".join(page for _, page in sorted(pages, key=place))


def read_samples(media: bytes) -> tuple[bytes, dict]:
    """The samples of the one sample stream among the file's streams, and what its pages tell. A level stream must agree."""
    streams = demultiplex(media)
    found, told = ([s for s in streams.values() if s.packets and s.packets[0].startswith(name)] for name in (NAME, LEVELS))
    if len(found) != 1:
        raise OggError(f"{len(found)} sample streams")
    stream = found[0]
    _, rate, channels, bits, frame = HEAD.unpack(stream.packets[0])
    samples = b"".join(stream.packets[1:])
    seconds = stream.timestamps(rate)
    if stream.marks[-1][0] != len(samples):
        raise OggError("the last position is not the number of samples")
    if any(s.packets[1:] != levels_of(samples) or s.marks[-1][0] != len(samples) for s in told):
        raise OggError("the levels are not those of the samples")
    levels = [LEVEL.unpack(x) for s in told for x in s.packets[1:]]
    return samples, {
        "streams": len(streams), "pages": sum(s.n_pages for s in streams.values()), "packets": len(stream.packets) - 1, "rate": rate, "channels": channels, "bits": bits, "frame": frame,
        "seconds": seconds[-1], "closed": all(s.last for s in streams.values()), "least": min((a for a, _, _ in levels), default=None), "most": max((b for _, b, _ in levels), default=None),
    }


def padded(data: bytes, unit: int = FRAME) -> bytes:
    """The data and bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (-len(data) % unit if data else unit)


def media(payload: Column) -> Column:
    """Column of binary: the payload as an Ogg file. Null and empty: a file without samples. Equal payloads, equal files."""

    @F.pandas_udf("binary")
    def files(batch: pd.Series) -> pd.Series:
        return pd.Series([mux_samples(bytes(x or b""), zlib.crc32(x or b"")) for x in batch], dtype=object)

    return files(payload)


def describe(media_column: Column) -> Column:
    """Column of struct: the samples and figures of Ogg files; for a null or damaged file `error` says why, the rest is null."""

    @F.pandas_udf("samples binary, streams int, pages int, packets int, rate int, seconds double, error string")
    def told(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for x in batch:
            try:
                samples, about = read_samples(bytes(x or b""))
                rows.append((samples, *(about[k] for k in ("streams", "pages", "packets", "rate", "seconds")), None))
            except OggError as error:
                rows.append((None,) * 6 + (str(error),))
        frame = pd.DataFrame(rows, columns=["samples", "streams", "pages", "packets", "rate", "seconds", "error"])
        return frame.astype({k: "Int32" for k in ("streams", "pages", "packets", "rate")} | {"seconds": "Float64"})

    return told(media_column)


def stored(text: Column) -> Column:
    """Column of struct: each whole text (null: empty) as UTF-8, padded to the unit, stored as an Ogg file, read back and
    described. The file lives within a batch. Files are written per text; equal texts give equal files."""
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    @arrow_udf(fields)
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in frugal(batches):
            rows = [describe_one(x) for x in strings(batch)]
            kinds = [pa.int64() if f.endswith("long") else pa.string() for f in fields.split(", ")]
            yield structs(**{f.split()[0]: pa.array([r[k] for r in rows], kinds[k]) for k, f in enumerate(fields.split(", "))})

    def describe_one(text: str) -> tuple:
        data = text.encode("utf-8", "replace")
        payload = padded(data)
        file = mux_samples(payload, zlib.crc32(payload))
        back, about = read_samples(file)
        mean = float(np.frombuffer(back, np.uint8).mean())
        feature = ";".join(f"{k}={about[k]}" for k in ("streams", "pages", "packets", "rate", "least", "most")) + f";seconds={about['seconds']:.6f};mean={mean:.6f}"
        return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature

    return told(text)
