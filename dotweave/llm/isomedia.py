"""ISO base media containers as a media column.

``pack`` stores bytes as 8-bit PCM in an ISO container; ``probe`` walks the
nested boxes of any such container, decodes its sample tables and gives codec,
duration and key-frame byte ranges without decoding a payload; ``payload``
reads the stored samples back through the tables.

Edge cases: empty and null texts give one frame of padding; a text of any length
is stored whole (64-bit sizes beyond 4 GB); a truncated, empty or foreign container
gives no tracks rather than an error; repeated rows give repeated rows; an empty table
gives an empty one; only the kept columns and the text are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from dotweave.llm.common import map_text

FRAME = 576
RATE = 8000
CHUNK = 32  # frames a chunk; its first frame is marked as a key frame
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pack(data: bytes) -> bytes:
    """``data`` (a positive multiple of FRAME) as 8-bit mono PCM in one track, chunked, in front of its tables."""
    frames = len(data) // FRAME
    chunks = -(-frames // CHUNK)
    length = frames * FRAME
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = length + 16 > 0xFFFFFFFF
    head = struct.pack(">I4sQ", 1, b"mdat", length + 16) if wide else struct.pack(">I4s", length + 8, b"mdat")
    start = len(kind) + len(head)
    places = start + np.arange(chunks, dtype=np.int64) * CHUNK * FRAME
    last = frames - (chunks - 1) * CHUNK
    runs = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK)
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 8, struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16 if RATE < 65536 else 0))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, FRAME)),
        _full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64", struct.pack(">I", chunks), places.astype(">i8").tobytes()),
        _full(b"stss", struct.pack(">I", chunks), (1 + CHUNK * np.arange(chunks)).astype(">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length & 0xFFFFFFFF, 0x55C4, 0)),
        _full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"sound\0"),
        _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1"))), table),
    )
    track = _box(b"trak", _box(b"tkhd", b"\0\0\0\3", struct.pack(">IIIII", 0, 0, 1, 0, length & 0xFFFFFFFF), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, b"\0" * 8), media)
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, length & 0xFFFFFFFF), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2)), track)
    return b"".join((kind, head, data, movie))


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the body) of the boxes in a span; stops at the first that doesn't fit."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                return
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield kind, body, start + size
        start += size


def _tables(data: bytes, start: int, end: int, found: dict) -> dict:
    for kind, a, b in boxes(data, start, end):
        if kind in NESTED:
            _tables(data, a, b, found)
        else:
            found.setdefault(kind, (a, b))
    return found


def _array(data: bytes, span: tuple[int, int] | None, kind: str, width: int, skip: int = 4) -> np.ndarray:
    """The counted table of a full box; as many rows as its body really holds."""
    if span is None or span[1] - span[0] < skip + 4:
        return np.zeros((0, width), np.int64)
    a, b = span
    (count,) = struct.unpack_from(">I", data, a + skip)
    step = np.dtype(kind).itemsize * width
    count = min(count, (b - a - skip - 4) // step)
    return np.frombuffer(data, kind, count * width, a + skip + 4).astype(np.int64).reshape(count, width)


def tracks(data: bytes) -> list[dict]:
    """Codec, time scale, duration, and place and size of every sample of each track."""
    out = []
    for kind, a, b in boxes(data):
        if kind != b"moov":
            continue
        for inner, c, d in boxes(data, a, b):
            if inner != b"trak":
                continue
            t = _tables(data, c, d, {})
            head, stsd, stsz = t.get(b"mdhd"), t.get(b"stsd"), t.get(b"stsz")
            if head is None or stsd is None or head[1] - head[0] < 20 or stsd[1] - stsd[0] < 16:
                continue
            wide = data[head[0]] == 1 and head[1] - head[0] >= 32
            scale, duration = struct.unpack_from(">IQ", data, head[0] + 20) if wide else struct.unpack_from(">II", data, head[0] + 12)
            codec = data[stsd[0] + 12 : stsd[0] + 16].decode("latin-1")
            sizes = np.zeros(0, np.int64)
            if stsz and stsz[1] - stsz[0] >= 12:
                same, count = struct.unpack_from(">II", data, stsz[0] + 4)
                sizes = np.full(min(count, len(data)), same, np.int64) if same else _array(data, stsz, ">u4", 1, 8)[:, 0]
            places = (_array(data, t[b"co64"], ">u8", 1) if b"co64" in t else _array(data, t.get(b"stco"), ">u4", 1))[:, 0]
            runs = _array(data, t.get(b"stsc"), ">u4", 3)
            timing = _array(data, t.get(b"stts"), ">u4", 2)
            if len(runs) and len(places):
                until = np.append(runs[1:, 0], len(places) + 1)
                each = np.repeat(runs[:, 1], np.clip(until - runs[:, 0], 0, None))[: len(places)]
                chunk = np.repeat(np.arange(len(each)), each)[: len(sizes)]
                sizes = sizes[: len(chunk)]
                before = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                first = np.concatenate(([0], np.cumsum(each)))[:-1]
                first = np.minimum(first, max(len(sizes) - 1, 0))
                offsets = places[chunk] + before - before[first[chunk]] if len(sizes) else np.zeros(0, np.int64)
            else:
                sizes = offsets = np.zeros(0, np.int64)
            keys = _array(data, t.get(b"stss"), ">u4", 1)[:, 0] - 1 if b"stss" in t else np.arange(len(sizes))
            keys = keys[(keys >= 0) & (keys < len(sizes))]
            out.append({"codec": codec, "timescale": scale, "duration": duration, "ticks": int((timing[:, 0] * timing[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys})
    return out


def payload(data: bytes, track: dict) -> bytes:
    """The samples of a track, read back in order through its tables; neighbours are read together."""
    o, s = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    cut = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    begins, ends = o[np.concatenate(([0], cut))], (o + s)[np.concatenate((cut - 1, [len(o) - 1]))]
    return b"".join(data[a:b] for a, b in zip(begins.tolist(), ends.tolist()))


def probe(df: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """``keep`` plus the tracks of the containers in a binary column: codec, seconds, samples, key-frame (offset, length) ranges."""
    from pyspark.sql import functions as F

    @F.udf("array<struct<codec:string,seconds:double,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>>", useArrow=True)
    def walk(data):
        return [
            {"codec": t["codec"], "seconds": t["duration"] / t["timescale"] if t["timescale"] else 0.0, "samples": len(t["sizes"]), "keyframes": [{"offset": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["keys"]]}
            for t in tracks(bytes(data or b""))
        ]

    return df.select(*keep, walk(F.col(content)).alias("tracks"))


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(raw) // FRAME)) * FRAME
    return len(raw), raw + b"\xff" * (whole - len(raw))


def store(df: DataFrame, keep: list[str], text: str = "text", media: bool = False) -> DataFrame:
    """Stores each text as a container, reads it back and adds its digests, features and all its key-frame byte ranges; ``media`` adds the container itself."""

    def rows(texts: list[str]):
        for one in texts:
            n, data = padded(one)
            stored = pack(data)
            (track,) = tracks(stored)
            back = payload(stored, track)
            keys = track["keys"]
            feature = json.dumps(
                {
                    "codec": track["codec"],
                    "seconds": track["duration"] / track["timescale"],
                    "samples": len(track["sizes"]),
                    "keyframes": len(keys),
                    "first": [int(track["offsets"][keys[0]]), int(track["sizes"][keys[0]])],
                    "last": [int(track["offsets"][keys[-1]]), int(track["sizes"][keys[-1]])],
                },
                sort_keys=True,
            )
            ranges = list(zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist()))
            digest = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, [{"offset": a, "length": b} for a, b in ranges])
            yield (*digest, stored) if media else digest

    added = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, keyframes array<struct<offset:bigint,length:bigint>>"
    return map_text(df, keep, text, added + ", media binary" * media, rows)
