"""TIFF rasters: strips or tiles, plain, LZW, deflated or PackBits, of whole numbers or floats; windows read only what they meet."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from struct import calcsize, pack, unpack, unpack_from

import numpy as np

#: Fixed values of the format: tags, field types with their sizes, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS = 1, 5, 8, 32946, 32773


@dataclass(frozen=True)
class Head:
    """What a file's first directory says. origin, cell: of the upper left corner and a cell's size, None if unknown."""

    order: str
    tags: dict[int, tuple]
    height: int
    width: int
    samples: int
    kind: np.dtype
    origin: tuple[float, float] | None = None
    cell: tuple[float, float] | None = None
    epsg: int | None = None
    no_data: float | None = None


def read_head(data: bytes) -> Head:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    version = unpack_from(f"{order}H", data, 2)[0] if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = unpack_from(f"{order}Q", data, 8)[0] if big else unpack_from(f"{order}I", data, 4)[0]
    n, start, step, count, inline = (unpack_from(f"{order}Q", data, at)[0], at + 8, 20, "Q", 8) if big else (unpack_from(f"{order}H", data, at)[0], at + 2, 12, "I", 4)
    tags: dict[int, tuple] = {}
    for k in range(n):
        place = start + k * step
        tag, kind = unpack_from(f"{order}HH", data, place)
        (many,) = unpack_from(f"{order}{count}", data, place + 4)
        code = TYPES.get(kind)
        if code is None:
            continue
        form = f"{order}{many}{code}"
        value = place + step - inline
        if calcsize(form) > inline:
            value = unpack_from(f"{order}{count}", data, value)[0]
        tags[tag] = unpack_from(form, data, value)
    one = lambda tag, other: tags.get(tag, (other,))[0]
    bits, samples = tags.get(BITS, (1,)), one(SAMPLES, 1)
    if len(set(bits)) != 1 or bits[0] not in (8, 16, 32, 64):
        raise ValueError(f"samples of {bits} bits are not read")
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}.get(one(SAMPLE_FORMAT, 1), 'u') }{bits[0] // 8}")
    scale, tie, keys = tags.get(PIXEL_SCALE), tags.get(TIE_POINT), tags.get(GEO_KEYS, ())
    epsg = next((keys[k + 3] for wanted in (3072, 2048) for k in range(4, len(keys) - 3, 4) if keys[k] == wanted and keys[k + 1] == 0), None)
    origin = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if scale and tie else None
    empty = tags[NO_DATA][0].split(b"\0")[0].strip() if NO_DATA in tags else b""
    return Head(order, tags, one(HEIGHT, 0), one(WIDTH, 0), samples, kind, origin, tuple(scale[:2]) if scale else None, epsg, float(empty) if empty else None)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 starts the table anew, 257 ends."""
    out: list[bytes] = []
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    held = bits = 0
    size, before = 9, b""
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 256:
            del table[258:]
            size, before = 9, b""
            continue
        if code == 257:
            break
        word = table[code] if code < len(table) else before + before[:1]
        out.append(word)
        if before:
            table.append(before + word[:1])
            # The width grows one code early.
            size = min(12, (len(table) + 1).bit_length())
        before = word
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()

    def put(code: int, size: int) -> None:
        nonlocal held, bits
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    fresh = lambda: {bytes([k]): k for k in range(256)}
    table, size, word = fresh(), 9, b""
    put(256, size)
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word], size)
        table[more] = len(table) + 2
        word = data[k : k + 1]
        if len(table) + 2 == 4095:
            put(256, size)
            table, size = fresh(), 9
        else:
            size = (len(table) + 2).bit_length()
    if word:
        put(table[word], size)
        size = min(12, (len(table) + 3).bit_length())
    put(257, size)
    put(0, -bits % 8)
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def _block(head: Head, raw: bytes, height: int, width: int, samples: int) -> np.ndarray:
    way = head.tags.get(COMPRESSION, (PLAIN,))[0]
    if way not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACK_BITS):
        raise ValueError(f"compression {way} is not read")
    raw = raw if way == PLAIN else unpack_lzw(raw) if way == LZW else _unpack_bits(raw) if way == PACK_BITS else zlib.decompress(raw)
    size = height * width * samples * head.kind.itemsize
    raw = raw[:size].ljust(size, b"\0")
    predictor = head.tags.get(PREDICTOR, (1,))[0]
    if predictor == 2:
        steps = np.frombuffer(raw, head.kind).reshape(height, width, samples)
        # Differences wrap round, so they are summed as whole numbers of the same width.
        whole = steps.astype(f"u{head.kind.itemsize}") if head.kind.kind != "f" else steps.view(f"{head.order}u{head.kind.itemsize}").astype(f"u{head.kind.itemsize}")
        return np.cumsum(whole, axis=1, dtype=whole.dtype).view(head.kind.newbyteorder("="))
    if predictor == 3:
        # Bytes of the floats, highest first, one plane after the other along each row, as differences.
        n = width * samples
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(height, -1), axis=1, dtype=np.uint8).reshape(height, head.kind.itemsize, n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{head.kind.itemsize}").reshape(height, width, samples)
    return np.frombuffer(raw, head.kind).reshape(height, width, samples)


def read_window(data: bytes, row: int = 0, col: int = 0, height: int | None = None, width: int | None = None) -> np.ndarray:
    """(height, width, samples) of a window, cut to the raster. Only strips or tiles that it meets are unpacked."""
    head = read_head(data)
    height, width = (most if asked is None else asked for asked, most in ((height, head.height), (width, head.width)))
    top, left, bottom, right = max(row, 0), max(col, 0), min(row + height, head.height), min(col + width, head.width)
    out = np.zeros((max(bottom - top, 0), max(right - left, 0), head.samples), head.kind.newbyteorder("="))
    tiled = TILE_OFFSETS in head.tags
    if tiled:
        high, wide = head.tags[TILE_HEIGHT][0], head.tags[TILE_WIDTH][0]
    else:
        high, wide = min(head.tags.get(ROWS_PER_STRIP, (head.height,))[0], head.height), head.width
    offsets, sizes = head.tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], head.tags[TILE_SIZES if tiled else STRIP_SIZES]
    across, down = -(-head.width // wide), -(-head.height // high)
    planes = head.samples if head.tags.get(PLANAR, (1,))[0] == 2 else 1
    for plane in range(planes):
        for i in range(top // high, -(-bottom // high) if out.size else 0):
            for j in range(left // wide, -(-right // wide)):
                k = (plane * down + i) * across + j
                rows = high if tiled else min(high, head.height - i * high)
                part = _block(head, data[offsets[k] : offsets[k] + sizes[k]], rows, wide, head.samples // planes)
                r0, r1, c0, c1 = max(top, i * high), min(bottom, i * high + rows), max(left, j * wide), min(right, (j + 1) * wide)
                bands = slice(None) if planes == 1 else slice(plane, plane + 1)
                out[r0 - top : r1 - top, c0 - left : c1 - left, bands] = part[r0 - i * high : r1 - i * high, c0 - j * wide : c1 - j * wide]
    return out


def encode(array: np.ndarray, compression: int = DEFLATE, tile: int | None = None, origin: tuple[float, float] | None = None, cell: tuple[float, float] | None = None, epsg: int | None = None, no_data: float | None = None, predictor: int = 1) -> bytes:
    """A little-endian TIFF of (h, w) or (h, w, samples), in tiles of a side that is a multiple of 16, or in strips of 64 rows."""
    array = array[:, :, None] if array.ndim == 2 else array
    h, w, samples = array.shape
    kind = array.dtype.newbyteorder("<")
    high, wide = (tile, tile) if tile else (min(64, h), w)
    blocks = []
    for top in range(0, h, high):
        for left in range(0, w, wide):
            part = array[top : top + high, left : left + wide].astype(kind)
            if tile:
                part = np.pad(part, ((0, high - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = np.ascontiguousarray(part).tobytes()
            blocks.append(raw if compression == PLAIN else pack_lzw(raw) if compression == LZW else zlib.compress(raw))
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags: dict[int, tuple[int, tuple]] = {
        WIDTH: (4, (w,)), HEIGHT: (4, (h,)), BITS: (3, (kind.itemsize * 8,) * samples), COMPRESSION: (3, (compression,)), PHOTOMETRIC: (3, (2 if samples == 3 else 1,)), SAMPLES: (3, (samples,)),
        PLANAR: (3, (1,)), PREDICTOR: (3, (predictor,)), SAMPLE_FORMAT: (3, (form,) * samples),
    }
    tags |= {TILE_WIDTH: (4, (wide,)), TILE_HEIGHT: (4, (high,))} if tile else {ROWS_PER_STRIP: (4, (high,))}
    if origin and cell:
        tags |= {PIXEL_SCALE: (12, (*cell, 0.0)), TIE_POINT: (12, (0.0, 0.0, 0.0, *origin, 0.0))}
    if epsg:
        tags[GEO_KEYS] = (3, (1, 1, 0, 1, 3072, 0, 1, epsg))
    if no_data is not None:
        tags[NO_DATA] = (2, (f"{no_data:g}".encode() + b"\0",))
    sizes = tuple(map(len, blocks))
    offsets = tuple(int(x) for x in 8 + np.cumsum([0, *sizes[:-1]]))
    tags |= {TILE_OFFSETS if tile else STRIP_OFFSETS: (4, offsets), TILE_SIZES if tile else STRIP_SIZES: (4, sizes)}
    body = bytearray(b"".join(blocks))
    body += b"\0" * (len(body) % 2)
    entries = bytearray()
    for tag, (code, values) in sorted(tags.items()):
        many = len(values[0]) if code == 2 else len(values)
        raw = values[0] if code == 2 else pack(f"<{many}{TYPES[code]}", *values)
        if len(raw) > 4:
            at = 8 + len(body)
            body += raw + b"\0" * (len(raw) % 2)
            raw = pack("<I", at)
        entries += pack("<HHI", tag, code, many) + raw.ljust(4, b"\0")
    return b"II" + pack("<HI", 42, 8 + len(body)) + bytes(body) + pack("<H", len(tags)) + bytes(entries) + b"\0\0\0\0"


def is_tiff(data: bytes) -> bool:
    return data[:4] in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+") and unpack("<H" if data[:2] == b"II" else ">H", data[2:4])[0] in (42, 43)
