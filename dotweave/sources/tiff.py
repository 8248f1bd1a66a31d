"""Greyscale TIFF files (classic and big) as segments: strips or tiles that are decoded one by one.

Compression: none, LZW, Deflate and PackBits, with or without differences along the
rows; samples of 8 to 64 bits. What else there is is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Numbers of TIFF tags, their field sizes by type, and of compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 323, 324, 325, 339
FIELD_BYTES = {1: 1, 3: 2, 4: 4, 13: 4, 16: 8, 18: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773


def _directories(content: bytes, name: str) -> Iterator[tuple[str, dict[int, list[int]]]]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    version = struct.unpack_from(order + "H", content, 2)[0] if order and len(content) > 8 else 0
    if version not in (42, 43):
        raise ValueError(f"{name}: neither .npy nor TIFF")
    big = version == 43
    count_kind, word = ("Q", "Q") if big else ("H", "I")
    entry, inline = (20, 8) if big else (12, 4)
    (at,) = struct.unpack_from(order + word, content, 8 if big else 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + count_kind, content, at)
        first = at + struct.calcsize(count_kind)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            begin = first + entry * k
            tag, kind, count = struct.unpack_from(order + "HH" + word, content, begin)
            size = FIELD_BYTES.get(kind)
            if size:
                place = begin + entry - inline
                if size * count > inline:
                    (place,) = struct.unpack_from(order + word, content, place)
                tags[tag] = np.frombuffer(content, np.dtype(f"{order}u{size}"), count, place).astype(int).tolist()
        yield order, tags
        (at,) = struct.unpack_from(order + word, content, first + entry * n)


def segments(content: bytes, name: str) -> Iterator[tuple[int, int, int, int, int, int, str, int, int, bytes]]:
    """(page, y, x, height and width kept, width stored, sample type, compression, predictor, bytes) of each strip or tile."""
    for z, (order, tags) in enumerate(_directories(content, name)):
        width, height, bits = tags[WIDTH][0], tags[HEIGHT][0], tags.get(BITS, [1])[0]
        packed, predictor = tags.get(COMPRESSION, [NONE])[0], tags.get(PREDICTOR, [1])[0]
        form = {1: "u", 2: "i", 3: "f"}.get(tags.get(FORMAT, [1])[0])
        if packed not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or bits not in (8, 16, 32, 64) or tags.get(SAMPLES, [1])[0] != 1 or form is None or predictor not in (1, 2) or (predictor == 2 and form == "f"):
            raise ValueError(f"{name}: a kind of TIFF that isn't read")
        kind = f"{order}{form}{bits // 8}"
        if TILE_OFFSETS in tags:
            wide, high, places, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_OFFSETS], tags[TILE_SIZES]
        else:
            wide, high, places, sizes = width, min(tags.get(STRIP_ROWS, [height])[0], height), tags[STRIP_OFFSETS], tags[STRIP_SIZES]
        across = -(-width // wide)
        for k, (a, size) in enumerate(zip(places, sizes)):
            y, x = k // across * high, k % across * wide
            yield z, y, x, min(high, height - y), min(wide, width - x), wide, kind, packed, predictor, content[a : a + size]


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; a code is widened one entry early."""
    clear, end = 256, 257
    first = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, last = list(first), 9, b""
    out, held, bits = bytearray(), 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == end:
            break
        if code == clear:
            table, width, last = list(first), 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif last and code == len(table):
            now = last + last[:1]
        else:
            raise ValueError("a broken LZW code")
        out += now
        if last:
            table.append(last + now[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        last = now
    return bytes(out)


def decode(segment: tuple) -> np.ndarray:
    """The samples of a segment that belong to the picture."""
    _, _, _, height, width, stored, kind, packed, predictor, data = segment
    if packed == LZW:
        data = unpack_lzw(data)
    elif packed in (DEFLATE, OLD_DEFLATE):
        data = zlib.decompress(data)
    elif packed == PACKBITS:
        data = unpack_bits(data)
    rows = np.frombuffer(data, np.dtype(kind), height * stored).reshape(height, stored)
    if predictor == 2:
        rows = np.cumsum(rows, axis=1, dtype=rows.dtype)  # differences wrap around like their sums
    return rows[:, :width]
