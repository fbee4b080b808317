"""Media columns (operator 8): signatures are sniffed, structures validated, declared types corrected, media carved.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass. Each hit is only a candidate: the
format's validator walks the structure from there and states the length that the format's own fields give, or None.
A hit that stands where the column's value begins gives its true type; other valid hits are embedded media, which
are carved as (type, offset, length). Automaton and validators see whole values.

Defined cases: a null value has no type and carves nothing; an empty or null text is a payload of 576 padding bytes; repeated
rows and equal texts give equal values; a null doc_id stays null; an empty table gives no rows; of media that begin at
one place the longest comes first; other columns aren't read. The time grows with the value's length and hits only: marks
that end a format are found in the same pass and looked up, not searched for from each hit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import in_slices

OPAQUE = "application/octet-stream"

#: Magic bytes, by media type, and how far before the magic the format begins.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"BM": ("image/bmp", 0),
    b"P5\n": ("image/x-portable-graymap", 0),
    b"WAVEfmt ": ("audio/wav", 8),
    b"WEBPVP8": ("image/webp", 8),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
    b"ftyp": ("video/mp4", 4),
    b"%PDF-": ("application/pdf", 0),
    b"PK\x03\x04": ("application/zip", 0),
}


#: Marks that formats end with.
PDF_END, PDF_START, ZIP_END, JPEG_END = b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9"
MARKS = (PDF_END, PDF_START, ZIP_END, JPEG_END)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Of magic bytes, and of the marks that validators look for."""
    found = ahocorasick.Automaton()
    for magic, (kind, back) in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, back, magic))
    for mark in MARKS:
        found.add_word(mark.decode("latin-1"), (None, 0, mark))
    found.make_automaton()
    return found


class Value(bytes):
    """Bytes with the places of all marks, so that no validator searches on from each hit, and with where walks end."""

    marks: dict[bytes, list[int]]
    ends: dict[str, dict[int, int | None]]

    def walked(self, kind: str, i: int, step: Callable[[int], tuple[int | None, int | None]]) -> int | None:
        """Where the steps from i on end, None if nowhere. step gives the next place, or None and the end. What a step
        does depends on its place alone, so each place is passed once for all hits of the value."""
        known, path = self.ends.setdefault(kind, {}), []
        while i not in known:
            path.append(i)
            after, end = step(i)
            if after is None:
                known[i] = end
            else:
                i = after
        end = known[i]
        for p in path:
            known[p] = end
        return end

    def next(self, mark: bytes, at: int) -> int:
        """The first place of mark from at on, or -1."""
        places = self.marks[mark]
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1


def png_length(b: bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return None


def gif_length(b: Value, at: int) -> int | None:
    if at + 13 > len(b):
        return None

    def block(i: int) -> tuple[int | None, int | None]:
        return (i + b[i] + 1, None) if i < len(b) and b[i] else (None, i + 1)

    def part(i: int) -> tuple[int | None, int | None]:
        if i < len(b) and b[i] == 0x3B:
            return None, i + 1
        if i < len(b) and b[i] == 0x21:
            return b.walked("gif-blocks", i + 2, block), None
        if i + 10 <= len(b) and b[i] == 0x2C:
            return b.walked("gif-blocks", i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0), block), None
        return None, None

    flags = b[at + 10]
    end = b.walked("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0), part)
    return None if end is None else end - at


def jpeg_length(b: Value, at: int) -> int | None:
    i = at + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at
        if kind in (0x00, 0x01, 0xFF) or 0xD0 <= kind <= 0xD8:
            return None
        i += 2 + struct.unpack_from(">H", b, i + 2)[0]
        if kind == 0xDA:
            end = b.next(JPEG_END, i)
            return end + 2 - at if end >= 0 else None
    return i + 2 - at if b[i : i + 2] == b"\xff\xd9" else None


def bmp_length(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, pixels, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (max(width, 0) * bits + 31) // 32 * 4
    good = reserved == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height
    return size if good and pixels >= 14 + header and size == pixels + row * abs(height) and at + size <= len(b) else None


def pgm_length(b: bytes, at: int) -> int | None:
    head = b[at : at + 40].split(b"\n", 3)
    if len(head) < 4 or len(dims := head[1].split(b" ")) != 2 or not all(x.isdigit() for x in (*dims, head[2])) or not 0 < int(head[2]) < 256:
        return None
    size = sum(len(x) + 1 for x in head[:3]) + int(dims[0]) * int(dims[1])
    return size if at + size <= len(b) else None


def riff_length(b: bytes, at: int) -> int | None:
    """Of RIFF forms: every chunk has to end within the length that the form states."""
    if at < 0 or b[at : at + 4] != b"RIFF" or at + 12 > len(b):
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    i = at + 12
    while i + 8 <= at + size <= len(b):
        i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
    return size if i == at + size else None


def flac_length(b: bytes, at: int) -> int | None:
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127 or i + 4 + n > len(b):
            return None
        last, i, first = b[i] & 0x80, i + 4 + n, False
        if last:  # a frame has to follow, but frames state no end: the medium is the rest of the value
            return len(b) - at if b[i : i + 2] in (b"\xff\xf8", b"\xff\xf9") else None
    return None


def ogg_length(b: Value, at: int) -> int | None:
    def page(i: int) -> tuple[int | None, int | None]:
        if b[i : i + 5] != b"OggS\0" or i + 27 > len(b):
            return None, i
        n = 27 + b[i + 26] + sum(b[i + 27 : i + 27 + b[i + 26]])
        if i + n > len(b):
            return None, None
        return (None, i + n) if b[i + 5] & 4 else (i + n, None)

    end = b.walked("ogg", at, page)
    return None if end is None else end - at or None


def mp4_length(b: Value, at: int) -> int | None:
    def box(i: int) -> tuple[int | None, int | None]:
        n = struct.unpack_from(">I", b, i)[0] if i + 8 <= len(b) else 0
        return (None, i) if n < 8 or i + n > len(b) or not b[i + 4 : i + 8].isalnum() else (i + n, None)

    return (b.walked("mp4", at, box) - at or None) if at >= 0 else None


def pdf_length(b: Value, at: int) -> int | None:
    end, start = b.next(PDF_END, at), b.next(PDF_START, at)
    return end + 5 - at if end >= 0 and b[at + 5 : at + 6].isdigit() and 0 <= start <= end - len(PDF_START) else None


def zip_length(b: Value, at: int) -> int | None:
    end = b.next(ZIP_END, at)
    if end < 0 or end + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + comment - at if at + offset + size == end and end + 22 + comment <= len(b) else None


VALID = {
    "image/png": png_length, "image/gif": gif_length, "image/jpeg": jpeg_length, "image/bmp": bmp_length, "image/x-portable-graymap": pgm_length, "audio/wav": riff_length,
    "image/webp": riff_length, "audio/flac": flac_length, "audio/ogg": ogg_length, "video/mp4": mp4_length, "application/pdf": pdf_length, "application/zip": zip_length,
}


def sniffed(data: bytes) -> list[tuple[str, int, int]]:
    """All valid media in data as (type, offset, length), by offset; nothing is cut or limited."""
    value, hits = Value(data), []
    value.marks, value.ends = {m: [] for m in MARKS}, {}
    for end, (kind, back, magic) in automaton().iter(data.decode("latin-1")):
        at = end + 1 - len(magic) - back
        if kind is None:
            value.marks[magic].append(at)
        elif at >= 0:
            hits.append((kind, at))
    found = [(kind, at, length) for kind, at in hits if (length := VALID[kind](value, at)) is not None]
    return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def carved(data: bytes, found: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, bytes]]:
    """The embedded media of data with their bytes: those that no other found medium contains, but not data itself.
    found: what sniffed(data) gives, where that is known."""
    out, end = [], 0
    for kind, at, n in sniffed(data) if found is None else found:
        if at >= end and (at or n < len(data)):
            out.append((kind, at, data[at : at + n]))
            end = at + n
    return out


def true_type(data: bytes | None, declared: str | None, found: list[tuple[str, int, int]] | None = None) -> str | None:
    """The sniffed type where the value begins with a valid medium, else the declared one (null values: None)."""
    if data is None:
        return None
    return next((kind for kind, at, _ in (sniffed(data) if found is None else found) if at == 0), declared)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono samples as a WAV file."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def wav_samples(media: bytes) -> bytes:
    """The samples of such a file, found by its chunks."""
    if riff_length(media, 0) is None:
        raise ValueError("not a WAV file")
    i = 12
    while i + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, i)
        if kind == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("a WAV file without samples")


def stored(text: str, unit: int = 576) -> tuple[int, bytes]:
    """The bytes of a text, and its WAV file: padded with 255 to a positive multiple of unit."""
    raw = text.encode()
    return len(raw), wav(raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0))


def media_features(docs: DataFrame, declared: str | None = None, text: str = "text") -> DataFrame:
    """Per row of docs, from the stored form read back: sizes, checksums, and as feature the corrected type with the
    media that are embedded in it. declared names a column of declared types; without one, and where it is null, a
    value is declared to be application/octet-stream. No shuffle."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(doc_id: int | None, declared: str, text: str) -> tuple:
        n, media = stored(text)
        payload = wav_samples(media)
        found = sniffed(media)
        inside = carved(media, found)
        feature = f"{true_type(media, declared, found)};embedded={','.join(f'{k}@{at}+{len(b)}' for k, at, b in inside)};mean={np.frombuffer(payload, np.uint8).mean():.4f};zero_crossings={crossings(payload)}"
        return doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in in_slices(batches, text):
            rows = [row(*x) for x in zip(batch.column("doc_id").to_pylist(), batch.column("declared").to_pylist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    stated = F.coalesce(F.col(declared), F.lit(OPAQUE)) if declared else F.lit(OPAQUE)
    rows_ = docs.select("doc_id", stated.alias("declared"), F.coalesce(F.col(text), F.lit("")).alias(text))
    return rows_.mapInArrow(features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def crossings(samples: bytes) -> int:
    """How often neighbouring samples lie on two sides of the middle value."""
    above = np.frombuffer(samples, np.uint8) >= 128
    return int(np.count_nonzero(above[1:] != above[:-1]))
