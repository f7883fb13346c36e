"""Media columns: sniff signatures, correct declared types, carve embedded media.

An Aho-Corasick automaton finds all magic bytes of a value in one pass; a validator
of the format then confirms each hit by its structure and gives its length.  The hit
at offset 0 is the value's true type; confirmed hits elsewhere are embedded media.

Texts become media to try this on: each is padded and stored, losslessly, as the
samples of a WAV or the pixels of a PNG or BMP; WAV and PNG carry a small picture of it
inside.  Some are declared as what they are, others as text.  What is read back rests on
what the signatures say, never on the declaration.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches

UNIT = 64
RATE = 8000
WIDTH = 64
THUMB = 8
PLAIN = "application/octet-stream"
SNIFFED = "media_type string, media_length long, corrected boolean, embedded array<struct<media_type:string,start:long,length:long>>"


def wav_length(b: memoryview, at: int) -> int | None:
    """RIFF/WAVE: chunks that fill the declared size, a format and a data chunk."""
    if len(b) < at + 12 or bytes(b[at + 8 : at + 12]) != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        seen.add(bytes(b[pos : pos + 4]))
        pos += 8 + struct.unpack_from("<I", b, pos + 4)[0]
        pos += (pos - at) % 2
    return end - at if {b"fmt ", b"data"} <= seen and pos in (end, end + 1) else None


def png_length(b: memoryview, at: int) -> int | None:
    """PNG: header chunk first, every checksum right, up to the end chunk."""
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size = struct.unpack_from(">I", b, pos)[0]
        kind = bytes(b[pos + 4 : pos + 8])
        end = pos + 12 + size
        if end > len(b) or first and (kind != b"IHDR" or size != 13):
            return None
        if zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return None


def gif_length(b: memoryview, at: int) -> int | None:
    """GIF: screen descriptor, then blocks up to the trailer."""
    if at + 13 > len(b):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    pos, images = at + 13 + table(b[at + 10]), 0
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at if images else None
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            pos += 11 + table(b[pos + 9])
            images += 1
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return None


def jpeg_length(b: memoryview, at: int) -> int | None:
    """JPEG: marker segments, a scan, and the end marker."""
    pos = at + 2
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return None
        mark = b[pos + 1]
        if mark == 0xFF:
            pos += 1
            continue
        if mark == 0xD9 or mark < 0xC0 or 0xD0 <= mark <= 0xD8:
            return None
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark != 0xDA:
            continue
        whole = b.obj
        while True:
            pos = whole.find(b"\xff", pos)
            if pos < 0 or pos + 1 >= len(b):
                return None
            if b[pos + 1] == 0xD9:
                return pos + 2 - at
            if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7 and b[pos + 1] != 0xFF:
                break
            pos += 1 if b[pos + 1] == 0xFF else 2
    return None


def bmp_length(b: memoryview, at: int) -> int | None:
    """BMP: sizes of file, header and pixels agree."""
    if at + 54 > len(b):
        return None
    size, zero, start, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or planes != 1 or head not in (40, 108, 124) or depth not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        return None
    pixels = (width * depth + 31) // 32 * 4 * abs(height)
    return size if start >= 14 + head and size == start + pixels and at + size <= len(b) else None


def gzip_length(b: memoryview, at: int) -> int | None:
    """gzip: inflates to its end with the right checksum."""
    d = zlib.decompressobj(31)
    try:
        rest = d.decompress(b[at:], 1)
        while not d.eof and d.unconsumed_tail:
            rest = d.decompress(d.unconsumed_tail, 1 << 20)
        if not d.eof:
            d.decompress(b"", 1)
    except zlib.error:
        return None
    del rest
    return len(b) - at - len(d.unused_data) if d.eof else None


def pdf_length(b: memoryview, at: int) -> int | None:
    """PDF: a version, and the last end mark before the next document."""
    whole = b.obj
    if not bytes(b[at + 5 : at + 8]).replace(b".", b"").isdigit():
        return None
    after = whole.find(b"%PDF-", at + 5)
    end = whole.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    return end + 5 - at if end >= 0 and whole.find(b"startxref", at, end) >= 0 else None


#: Magic bytes, media type, validator.
FORMATS: tuple[tuple[bytes, str, Callable], ...] = (
    (b"RIFF", "audio/wav", wav_length),
    (b"\x89PNG\r\n\x1a\n", "image/png", png_length),
    (b"GIF87a", "image/gif", gif_length),
    (b"GIF89a", "image/gif", gif_length),
    (b"\xff\xd8\xff", "image/jpeg", jpeg_length),
    (b"BM", "image/bmp", bmp_length),
    (b"\x1f\x8b\x08", "application/gzip", gzip_length),
    (b"%PDF-", "application/pdf", pdf_length),
)

_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for magic, kind, check in FORMATS:
            _automaton.add_word(magic.decode("latin-1"), (len(magic), kind, check))
        _automaton.make_automaton()
    return _automaton


def sniff_bytes(value: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """True type, its length, and embedded media (type, start, length) in order.

    A value that is no known format is ``application/octet-stream`` of its full length.
    Media inside the outer format are reported, those inside embedded ones are not.
    """
    view = memoryview(value)
    kind, length, inner, free = PLAIN, len(value), [], 0
    for end, (size, name, check) in automaton().iter(value.decode("latin-1")):
        at = end - size + 1
        if at and at < free:
            continue
        n = check(view, at)
        if n is None:
            continue
        if at == 0:
            kind, length = name, n
        else:
            inner.append((name, at, n))
            free = at + n
    return kind, length, inner


def sniff(media: DataFrame, value_col="media", declared_col="declared") -> DataFrame:
    """All columns of ``media`` and ``media_type, media_length, corrected, embedded``.

    ``corrected``: the declared type (null counts as unknown) is not the true one.
    Null values give type null, length 0; empty ones are octet streams; repeated rows
    stay repeated.  If ``media`` has a column of one of the four new names, that is an error.
    """
    new = {"media_type", "media_length", "corrected", "embedded"}
    if clash := sorted(new.intersection(c.lower() for c in media.columns)):
        raise ValueError(f"columns {clash} are there already")
    names = [*media.columns, "media_type", "media_length", "corrected", "embedded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, sizes, wrong, inner = [], [], [], []
            for v, said in zip(b.column(value_col), b.column(declared_col), strict=True):
                kind, n, found = sniff_bytes(v.as_py()) if v.is_valid else (None, 0, [])
                kinds.append(kind)
                sizes.append(n)
                wrong.append(said.as_py() != kind)
                inner.append([{"media_type": k, "start": s, "length": m} for k, s, m in found])
            kind = pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kinds, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(inner, kind)], names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema), SNIFFED])
    return bounded_batches(media).mapInArrow(run, schema)


def carve(sniffed: DataFrame, value_col="media", keep=()) -> DataFrame:
    """One row per embedded medium: the kept columns, ``media_type, start, bytes``."""
    x = sniffed.select(*keep, F.col(value_col).alias("__v"), F.explode("embedded").alias("__m"))
    piece = F.substring(F.col("__v"), F.col("__m.start").cast("int") + 1, F.col("__m.length").cast("int"))
    return x.select(*keep, F.col("__m.media_type").alias("media_type"), F.col("__m.start").alias("start"), piece.alias("bytes"))


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``UNIT``."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def png(pixels: bytes, width: int, extra: bytes = b"") -> bytes:
    """8-bit grey levels as PNG; ``extra`` goes into a private chunk."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.zeros((len(pixels) // width, width + 1), np.uint8)  # each row after its filter, none
    rows[:, 1:] = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    inner = chunk(b"thMb", extra) if extra else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + inner + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def bmp(pixels: bytes, width: int) -> bytes:
    """8-bit grey levels as BMP, rows from the top; ``width`` is a multiple of 4."""
    start = 54 + 1024
    head = b"BM" + struct.pack("<IIIIiiHHIIiiII", start + len(pixels), 0, start, 40, width, -(len(pixels) // width), 1, 8, 0, len(pixels), 0, 0, 256, 256)
    return head + bytes(x for level in range(256) for x in (level, level, level, 0)) + pixels


def wav(samples: bytes, extra: bytes = b"") -> bytes:
    """Unsigned 8-bit mono samples as WAV; ``extra`` goes into a chunk of its own."""
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)
    body = b"WAVE" + chunk(b"fmt ", struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)) + (chunk(b"pict", extra) if extra else b"") + chunk(b"data", samples)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def thumbnail(payload: bytes) -> bytes:
    """Mean levels of ``THUMB`` squared equal stretches."""
    return np.frombuffer(payload, np.uint8).reshape(THUMB * THUMB, -1).mean(1).astype(np.uint8).tobytes()


def store(raw: bytes) -> tuple[str, bytes]:
    """Declared type and stored form of a text's bytes; its checksum chooses both."""
    payload, pick = pad(raw), zlib.crc32(raw)
    small = thumbnail(payload)
    kind, value = (("audio/wav", wav(payload, png(small, THUMB))), ("image/png", png(payload, WIDTH, bmp(small, THUMB))), ("image/bmp", bmp(payload, WIDTH)))[pick % 3]
    return kind if pick >> 16 & 1 else "text/plain", value


def payload_of(kind: str, value: bytes) -> bytes:
    """Samples or pixels of a stored medium that its validator has confirmed."""
    if kind == "image/bmp":
        return value[struct.unpack_from("<I", value, 10)[0] :]
    if kind == "audio/wav":
        pos = 12
        while value[pos : pos + 4] != b"data":
            pos += 8 + struct.unpack_from("<I", value, pos + 4)[0]
            pos += pos % 2
        return value[pos + 8 : pos + 8 + struct.unpack_from("<I", value, pos + 4)[0]]
    if kind != "image/png":
        raise ValueError(f"not a stored medium: {kind}")
    pos, parts, width = 8, [], struct.unpack_from(">I", value, 16)[0]
    while pos < len(value):
        size = struct.unpack_from(">I", value, pos)[0]
        if value[pos + 4 : pos + 8] == b"IDAT":
            parts.append(value[pos + 8 : pos + 8 + size])
        pos += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def store_texts(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Texts as media: ``doc_id, n_bytes, declared, media``.

    Null text is empty; equal texts give equal media; repeated rows stay repeated, a
    null id stays null; an empty table gives no rows; other columns are not read.
    A text is limited to the 2 GB of a value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                raw = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column(1)]
                made = [store(r) for r in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([d for d, _ in made], pa.string()), pa.array([v for _, v in made], pa.binary())],
                    ["doc_id", "n_bytes", "declared", "media"],
                )

    x = bounded_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return x.mapInArrow(run, f"doc_id {x.schema['doc_id'].dataType.simpleString()}, n_bytes long, declared string, media binary")


def feature_of(value: bytes, declared: str | None) -> tuple[str, str]:
    """True type of a medium, and a line of it: ``!`` where the declaration was wrong, and what is carved out of it."""
    kind, _, inner = sniff_bytes(value)
    carved = "".join(f"+{k}@{start}:{n}#{zlib.crc32(value[start : start + n]):08x}" for k, start, n in inner)
    return kind, f"{kind}{'' if declared == kind else '!'}{carved}"


def digest(stored: DataFrame) -> DataFrame:
    """Digest columns of stored texts, read back from the stored bytes by their true type.

    ``feature``: the true type, whether it corrects the declared one, and type, place,
    length and checksum of every medium carved out of the stored one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for v, said in zip(b.column("media"), b.column("declared").to_pylist(), strict=True):
                value = v.as_buffer().to_pybytes()
                kind, feature = feature_of(value, said)
                back = payload_of(kind, value)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(value), hashlib.sha256(value).hexdigest(), feature))
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = stored.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.select("doc_id", "n_bytes", "declared", "media").mapInArrow(run, out)
