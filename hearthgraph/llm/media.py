"""Media columns: type sniffing by signatures, structure checks and carving of embedded media.

An Aho-Corasick automaton finds every magic number of a blob in one pass; a validator per format confirms structure
and length at each place, which corrects a wrong declared type and gives the exact span of embedded media.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import utf8

#: Magic bytes, the media type they announce and where in the file they stand.
SIGNATURES = (
    (b"RIFF", "riff", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"BM", "image/bmp", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"\x1f\x8b\x08", "application/gzip", 0),
    (b"OggS", "audio/ogg", 0),
    (b"fLaC", "audio/flac", 0),
    (b"ftyp", "video/mp4", 4),
)


@dataclass(frozen=True)
class Found:
    media_type: str
    start: int
    end: int


def _riff(b: bytes, i: int) -> Found | None:
    if i + 12 > len(b):
        return None
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(b[i + 8 : i + 12])
    if kind is None or end > len(b):
        return None
    at, chunks = i + 12, 0
    while at + 8 <= end:
        size = struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + size > end:
            return None
        at, chunks = at + 8 + size + (size & 1), chunks + 1
    return Found(kind, i, end) if chunks and at >= end else None


def _png(b: bytes, i: int) -> Found | None:
    at, first = i + 8, True
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        stop = at + 12 + size
        if stop > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[at + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None
        if kind == b"IEND":
            return Found("image/png", i, stop)
        at, first = stop, False
    return None


def _jpeg(b: bytes, i: int) -> Found | None:
    at = i + 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        kind = b[at + 1]
        size = struct.unpack_from(">H", b, at + 2)[0]
        if size < 2 or at + 2 + size > len(b):
            return None
        at += 2 + size
        if kind == 0xDA:  # entropy-coded data: 0xFF is followed by 0, a restart marker or the next segment
            while (at := b.find(b"\xff", at)) >= 0 and at + 1 < len(b):
                if b[at + 1] == 0xD9:
                    return Found("image/jpeg", i, at + 2)
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
            if at < 0:
                return None
    return None


def _gif(b: bytes, i: int) -> Found | None:
    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    if i + 13 > len(b):
        return None
    at = i + 13 + (3 << ((b[i + 10] & 7) + 1) if b[i + 10] & 0x80 else 0)
    while at < len(b):
        if b[at] == 0x3B:
            return Found("image/gif", i, at + 1)
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            at = blocks(at + 10 + (3 << ((b[at + 9] & 7) + 1) if b[at + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _bmp(b: bytes, i: int) -> Found | None:
    if i + 54 > len(b):
        return None
    size, reserved, data, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, i + 2)
    stride = (width * bits + 31) // 32 * 4
    right = reserved == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0
    return Found("image/bmp", i, i + size) if right and i + size <= len(b) and 14 + header <= data and data + stride * abs(height) <= size else None


@functools.lru_cache(maxsize=3)
def _places(b: bytes, mark: bytes) -> list[int]:
    """Where the mark stands: found once for a text, however many headers ask for it."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


@functools.lru_cache(maxsize=1)
def _directories(b: bytes) -> dict[int, int]:
    """End of the archive by its start, from each end record that points back to its directory; the first such wins."""
    out: dict[int, int] = {}
    for at in _places(b, b"PK\x05\x06"):
        if at + 22 <= len(b):
            size, offset, note = struct.unpack_from("<IIH", b, at + 12)
            i = at - size - offset
            if i >= 0 and b[i + offset : i + offset + 4] == b"PK\x01\x02" and at + 22 + note <= len(b):
                out.setdefault(i, at + 22 + note)
    return out


def _pdf(b: bytes, i: int) -> Found | None:
    ends, starts = _places(b, b"%%EOF"), _places(b, b"startxref")
    k, x = bisect_left(ends, i), bisect_left(starts, i)
    return Found("application/pdf", i, ends[k] + 5) if k < len(ends) and x < len(starts) and starts[x] + 9 <= ends[k] else None


def _zip(b: bytes, i: int) -> Found | None:
    end = _directories(b).get(i)
    return Found("application/zip", i, end) if end is not None else None


def _gzip(b: bytes, i: int) -> Found | None:
    d = zlib.decompressobj(31)
    try:
        at = i
        while at < len(b) and not d.eof:
            while (d.decompress(b[at : at + 65536] if not d.unconsumed_tail else d.unconsumed_tail, 1 << 20)) and d.unconsumed_tail:
                pass
            at += 65536
    except zlib.error:
        return None
    return Found("application/gzip", i, min(at, len(b)) - len(d.unused_data)) if d.eof else None


def _ogg(b: bytes, i: int) -> Found | None:
    at = i
    while b[at : at + 4] == b"OggS" and at + 27 <= len(b) and b[at + 4] == 0:
        n = b[at + 26]
        stop = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if stop > len(b):
            return None
        last, at = b[at + 5] & 4, stop
        if last:
            return Found("audio/ogg", i, at)
    return None


def _flac(b: bytes, i: int) -> Found | None:
    at, first = i + 4, True
    while at + 4 <= len(b):
        kind, size = b[at], int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind & 0x7F or size != 34):
            return None
        at, first = at + 4 + size, False
        if kind & 0x80:
            return Found("audio/flac", i, len(b)) if at + 2 <= len(b) and b[at] == 0xFF and b[at + 1] >> 2 == 0x3E else None
    return None


def _mp4(b: bytes, i: int) -> Found | None:
    at, seen = i, set()
    while at + 8 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if size < 8 or at + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        at += size
    return Found("video/mp4", i, at) if {b"ftyp", b"moov"} <= seen else None


VALIDATORS = {
    "riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4,
}


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    by_magic: dict[bytes, list] = {}
    for magic, kind, at in SIGNATURES:
        by_magic.setdefault(magic, []).append((len(magic), kind, at))
    for magic, entry in by_magic.items():
        a.add_word(magic.decode("latin-1"), entry)
    a.make_automaton()
    return a


def scan(b: bytes, a: ahocorasick.Automaton) -> list[Found]:
    """Every confirmed medium, by start; where two share a start the longer counts."""
    found: dict[int, Found] = {}
    for last, entries in a.iter(b.decode("latin-1")):
        for length, kind, at in entries:
            start = last - length + 1 - at
            if start >= 0 and (x := VALIDATORS[kind](b, start)) and (start not in found or found[start].end < x.end):
                found[start] = x
    return [found[k] for k in sorted(found)]


def sniff(b: bytes, declared: str | None, a: ahocorasick.Automaton) -> tuple[str, bool, list[Found]]:
    """(type, whether the declared type was wrong, embedded media). Without a confirmed medium at byte 0 the type is octet-stream."""
    found = scan(b, a)
    own = found[0].media_type if found and found[0].start == 0 else "application/octet-stream"
    return own, declared is not None and declared != own, [x for x in found if x.start > 0]


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM at 8 kHz: one sample per byte. Payloads are multiples of 64, so no chunk needs a pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
    return head + payload


def wav_samples(b: bytes, found: Found) -> bytes:
    """The data chunk of a confirmed WAV."""
    at = found.start + 12
    while at + 8 <= found.end:
        kind, size = struct.unpack_from("<4sI", b, at)
        if kind == b"data":
            return b[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return b""


def padded(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def feature_of(payload: bytes, found: list[Found]) -> str:
    """Statistics of the samples and the confirmed embedded media (type@start+length within the stored form)."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x, minlength=256)
    p = h[h > 0] / len(x)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    inner = ",".join(f"{f.media_type}@{f.start}+{f.end - f.start}" for f in found) or "none"
    return f"mean={x.mean():.4f};entropy={-(p * np.log2(p)).sum():.4f};peak={int(h.argmax())};crossings={crossings};embedded={inner}"


DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, type_corrected boolean"


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "audio/mpeg") -> DataFrame:
    """Store each text as a WAV, sniff the stored bytes against `declared`, carve the samples out again and describe them.

    Null or empty text is stored as 64 zero bytes. Texts are taken whole, one at a time. Equal texts give equal
    values, rows repeated whole are repeated, null ids stay null, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            raw, off = utf8(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                text = raw[off[i] : off[i + 1]].tobytes()
                blob = wav(padded(text))
                kind, wrong, inner = sniff(blob, declared, a)
                samples = wav_samples(blob, Found(kind, 0, len(blob)))
                rows.append((len(text), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature_of(samples, inner), kind, wrong))
            cols = list(zip(*rows)) if rows else [[] for _ in range(9)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, DIGEST_SCHEMA)


SNIFF_SCHEMA = "id long, media_type string, type_corrected boolean, embedded array<struct<media_type:string,start:long,end:long,content:binary>>"


def sniff_column(blobs: DataFrame, id_col: str, content_col: str, declared_col: str) -> DataFrame:
    """For a table of media: corrected type and carved media with their bytes. Null content counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kinds = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("content", pa.binary())]))
        for batch in batches:
            raw, off = utf8(batch.column(1))
            out = []
            for i, said in enumerate(batch.column(2).to_pylist()):
                b = raw[off[i] : off[i + 1]].tobytes()
                kind, wrong, inner = sniff(b, said, a)
                out.append((kind, wrong, [{"media_type": f.media_type, "start": f.start, "end": f.end, "content": b[f.start : f.end]} for f in inner]))
            cols = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.bool_()), pa.array(cols[2], kinds)], ["id", "media_type", "type_corrected", "embedded"])

    return blobs.select(blobs[id_col].cast("long").alias("id"), blobs[content_col], blobs[declared_col].cast("string")).mapInArrow(run, SNIFF_SCHEMA)
