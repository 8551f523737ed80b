"""Media columns: find what bytes are by their signatures, whatever they are declared to be.

An Aho-Corasick automaton finds the magic bytes of all formats in one walk over the bytes. Each place found
is only a candidate: the format's validator reads the structure from there, checks its lengths, and says
where the file ends. What stands at the start corrects the declared type; what stands inside other bytes is
carved out. Files found do not overlap: the first place wins, and the search goes on behind its end.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common

#: Magic bytes of the formats that are known (fixed values of the public formats).
MAGIC = {"wav": b"RIFF", "au": b".snd", "bmp": b"BM", "pgm": b"P5\n", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "jpeg": b"\xff\xd8\xff", "flac": b"fLaC"}
#: Formats that payloads are stored in; the row of an image is as long as ROW, and payloads are a multiple of it.
STORED = ("wav", "au", "bmp", "pgm", "png")
ROW = 192
#: What stands before the media in every CARRIED-th payload, by its checksum.
CARRIER, CARRIED = b"attachment\x00\x01", 5

_FILES = "array<struct<format:string,start:long,end:long>>"


# Validators: where the file that begins at `at` ends, or None.


def _wav(b: bytes, at: int) -> int | None:
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    i, seen = at + 12, set()
    while i + 8 <= end <= len(b):
        seen.add(b[i : i + 4])
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        i += 8 + n + n % 2
    return end if i == end and {b"fmt ", b"data"} <= seen else None


def _au(b: bytes, at: int) -> int | None:
    if len(b) < at + 24:
        return None
    head, size, coding, rate, channels = struct.unpack(">5I", b[at + 4 : at + 24])
    end = at + head + size
    return end if head >= 24 and 1 <= coding <= 27 and 0 < rate <= 1 << 20 and 1 <= channels <= 64 and end <= len(b) else None


def _bmp(b: bytes, at: int) -> int | None:
    if len(b) < at + 54:
        return None
    size, zero, first, header, width, height, planes, bits, packed, pixels = struct.unpack("<IIIIiiHHII", b[at + 2 : at + 38])
    row = (width * bits + 31) // 32 * 4
    ok = not zero and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and not packed
    return at + size if ok and first >= 14 + header and size == first + row * abs(height) and at + size <= len(b) else None


def _pgm(b: bytes, at: int) -> int | None:
    fields, i = [], at + 3
    while len(fields) < 3 and i < min(len(b), at + 64):
        j = i
        while j < len(b) and 48 <= b[j] <= 57 and j - i < 10:
            j += 1
        if j == i or j >= len(b) or b[j] not in b" \t\n\r":
            return None
        fields.append(int(b[i:j]))
        i = j + 1
    if len(fields) < 3 or not 0 < fields[2] < 256 or not fields[0] * fields[1]:
        return None
    end = i + fields[0] * fields[1]
    return end if end <= len(b) else None


def _png(b: bytes, at: int) -> int | None:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if i + 12 + n > len(b) or first != (kind == b"IHDR") or zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return None
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i
    return None


def _gif(b: bytes, at: int) -> int | None:
    if len(b) < at + 14 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return None
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    i = at + 13 + table(b[at + 10])
    while i < len(b):
        kind = b[i]
        if kind == 0x3B:
            return i + 1
        if kind == 0x21:
            i += 2
        elif kind == 0x2C and i + 10 < len(b):
            i += 11 + table(b[i + 9])
        else:
            return None
        while i < len(b) and b[i]:
            i += b[i] + 1
        i += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind, n = b[i + 1], int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2:
            return None
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if kind != 0xDA:
            continue
        while True:  # coded data: 0xFF is followed by 0 or a restart marker
            i = b.find(b"\xff", i)
            if i < 0 or i + 1 >= len(b):
                return None
            if b[i + 1] == 0xD9:
                return i + 2 if frame else None
            if b[i + 1] != 0 and not 0xD0 <= b[i + 1] <= 0xD7:
                break
            i += 2
    return None


def _flac(b: bytes, at: int) -> int | None:
    i, first = at + 4, True
    while i + 4 <= len(b):
        kind, n = b[i] & 127, int.from_bytes(b[i + 1 : i + 4], "big")
        if first and (kind or n != 34) or i + 4 + n > len(b):
            return None
        last, first, i = b[i] & 128, False, i + 4 + n
        if last:
            return len(b) if b[i : i + 1] == b"\xff" and i + 1 < len(b) and b[i + 1] & 0xFC == 0xF8 else None
    return None


VALIDATE = {"wav": _wav, "au": _au, "bmp": _bmp, "pgm": _pgm, "png": _png, "gif": _gif, "jpeg": _jpeg, "flac": _flac}


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for name, magic in MAGIC.items():
        out.add_word(magic.decode("latin-1"), name)
    out.make_automaton()
    return out


def sniff(b: bytes) -> list[tuple[str, int, int]]:
    """(format, start, end) of the media files in bytes, in order."""
    out: list[tuple[str, int, int]] = []
    at = 0
    for last, name in sorted(_automaton().iter(b.decode("latin-1")), key=lambda x: x[0] - len(MAGIC[x[1]])):
        start = last + 1 - len(MAGIC[name])
        if start >= at and (end := VALIDATE[name](b, start)) is not None:
            out.append((name, start, end))
            at = end
    return out


# Payloads as samples of 8 bits (images: rows of ROW of them).


def write(payload: bytes, form: str) -> bytes:
    n = len(payload)
    if form == "wav":
        pad = n % 2
        return b"RIFF" + struct.pack("<I", 36 + n + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * pad
    if form == "au":
        return b".snd" + struct.pack(">5I", 24, n, 2, 8000, 1) + payload
    if form == "bmp":
        return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + n, 0, 54, 40, ROW // 3, n // ROW, 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    if form == "pgm":
        return b"P5\n%d %d\n255\n" % (ROW, n // ROW) + payload
    rows = np.zeros((n // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return MAGIC["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, n // ROW, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read(media: bytes, form: str) -> bytes:
    """The samples of a file that write() could have made."""
    if form == "wav":
        i = 12
        while media[i : i + 4] != b"data":
            i += 8 + (n := int.from_bytes(media[i + 4 : i + 8], "little")) + n % 2
        return media[i + 8 : i + 8 + int.from_bytes(media[i + 4 : i + 8], "little")]
    if form == "au":
        head, size = struct.unpack(">II", media[4:12])
        return media[head : head + size]
    if form == "bmp":
        return media[int.from_bytes(media[10:14], "little") :]
    if form == "pgm":
        i = 0
        for _ in range(3):
            i = media.index(b"\n", i) + 1
        return media[i:]
    width, height = struct.unpack(">II", media[16:24])
    i, data = 8, []
    while media[i + 4 : i + 8] != b"IEND":
        n = int.from_bytes(media[i : i + 4], "big")
        if media[i + 4 : i + 8] == b"IDAT":
            data.append(media[i + 8 : i + 8 + n])
        i += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _map(rows: DataFrame, schema: str, fields: list[pa.DataType], make, first: str) -> DataFrame:
    """rows: doc_id, then the column `first`, then others; make has a value of each but doc_id."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, first):
                made = [make(*x) for x in zip(*(c.to_pylist() for c in part.columns[1:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[i] for m in made], t) for i, t in enumerate(fields))], names=names)

    return rows.mapInArrow(run, schema)


def _store(text: str) -> tuple[int, bytes, str]:
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % ROW or ROW * (not raw))
    check = zlib.crc32(payload)
    media = write(payload, STORED[check % len(STORED)])
    # what the media is declared to be says nothing about what it is
    return len(raw), CARRIER + media if check // 64 % CARRIED == 0 else media, STORED[check // 7 % len(STORED)]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and declared of each row of docs (doc_id, text): its text as a media file.

    The text's UTF-8 bytes, filled with spaces to a positive multiple of 192, are the samples; null is an empty
    text. Format, declared type and carrier follow from the bytes, so equal texts are stored alike.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return _map(rows, "doc_id long, n_bytes long, media binary, declared string", [pa.int64(), pa.binary(), pa.string()], _store, "text")


def identify(media: DataFrame) -> DataFrame:
    """doc_id, format, files and corrected of each row of media (doc_id, media, declared).

    files: the media files found, wherever they stand; format: of the file that the value begins with, else of
    the first carved one, else null; corrected: the declared type is not the format. Null and empty media have
    no files; other columns are not read.
    """

    def make(b: bytes | None, declared: str | None) -> tuple:
        found = sniff(b or b"")
        form = found[0][0] if found else None
        return form, [{"format": f, "start": s, "end": e} for f, s, e in found], form is not None and form != declared

    files = pa.list_(pa.struct([("format", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return _map(media.select(F.col("doc_id").cast("long").alias("doc_id"), "media", "declared"), f"doc_id long, format string, files {_FILES}, corrected boolean", [pa.string(), files, pa.bool_()], make, "media")


def carve(media: DataFrame) -> DataFrame:
    """doc_id, number, format and file (its bytes) of every media file in each row of media (doc_id, media).

    Null and empty media have none; repeated rows have theirs each; other columns are not read.
    """
    rows = media.select(F.col("doc_id").cast("long").alias("doc_id"), "media")
    files = pa.list_(pa.struct([("number", pa.int32()), ("format", pa.string()), ("file", pa.binary())]))
    make = lambda b: ([{"number": i, "format": f, "file": b[s:e]} for i, (f, s, e) in enumerate(sniff(b or b""))],)
    return _map(rows, "doc_id long, files array<struct<number:int,format:string,file:binary>>", [files], make, "media").select("doc_id", F.inline("files"))


def _digest(n_bytes: int, media: bytes, declared: str) -> tuple:
    found = sniff(media)
    form, start, end = found[0]
    payload = read(media[start:end], form)
    count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    p = count[count > 0] / len(payload)
    entropy = -sum(x * math.log2(x) for x in p.tolist())
    feature = f"{form}:{start}:{end};declared={declared};{'confirmed' if form == declared else 'corrected'};{'carved' if start else 'whole'};files={len(found)};values={int((count > 0).sum())};entropy={entropy:.4f}"
    return n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature


def op1_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in the media that all documents are stored as, and the payloads read from it."""
    stored = store(common.table(spark, sf_dir, "documents")).select("doc_id", "media", "n_bytes", "declared")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _map(stored, schema, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], lambda media, n, declared: _digest(n, media, declared), "media")
