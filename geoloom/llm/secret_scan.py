"""Secrets in texts: pattern matches, and keys and tokens whose encoding is confirmed before they are reported.

Base kinds are matches of three patterns. Added kinds are candidates in base64 or hexadecimal that decode to
a structure only keys and tokens have: a signed token's header and payload are JSON objects and the header
names an algorithm; a key is a DER sequence whose nested lengths fill it exactly and whose members are those
of a private key; an OpenSSH key's length-prefixed strings fill its bytes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common

#: In the order of spans that begin together; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key", "ssh")
BASE = 3
MASK = "[secret]"

_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![\w-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)", re.ASCII)
#: Lines of a key file may be apart by line feeds or, in quoted strings, by a backslash and n; headers come before the key.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:\s|\\[nr])*(?:[A-Z][A-Za-z-]{1,30}: [^\r\n\\]{1,200}(?:\s|\\[nr])+)*)([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
#: What an encrypted key in the older form says of its cipher.
_CIPHER = re.compile(r"DEK-Info: [A-Z0-9-]+,(?:[0-9A-Fa-f]{16}){1,2}(?![0-9A-Fa-f])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_NOT_BASE64 = re.compile(r"\\[nr]|[^A-Za-z0-9+/_=-]")

_SPANS = "array<struct<kind:string,start:int,end:int>>"


def unbase64(text: str) -> bytes | None:
    """Either alphabet, with or without padding."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(raw: bytes, at: int = 0, stop: int | None = None, depth: int = 0) -> tuple[int, list | bytes, int] | None:
    """The tag, the members or content, and the end of the element at a place before stop; None if a length doesn't fit."""
    stop = len(raw) if stop is None else stop
    if at + 2 > stop or depth > 8:
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > stop:
            return None
        n, at = int.from_bytes(raw[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    end = at + n
    if end > stop:
        return None
    if not tag & 0x20:
        return tag, raw[at:end], end
    members = []
    while at < end:
        if (x := der(raw, at, end, depth + 1)) is None:
            return None
        members.append(x)
        at = x[2]
    return (tag, members, end) if at == end else None


def private_key(raw: bytes | None) -> bool:
    """A DER private key: RSA, DSA, EC or PKCS 8, encrypted or not, that fills its bytes."""
    if not raw or raw[0] != 0x30 or (top := der(raw)) is None or top[2] != len(raw):
        return False
    tags = [t for t, _, _ in top[1]]
    if tags in ([2] * 9, [2] * 6):
        return top[1][0][1] in (b"\x00", b"\x01")
    if tags[:2] == [2, 4]:
        return top[1][0][1] == b"\x01" and len(top[1][1][1]) >= 16
    if tags[:3] == [2, 0x30, 4]:
        return top[1][0][1] in (b"\x00", b"\x01") and [t for t, _, _ in top[1][1][1]][:1] == [6]
    return tags == [0x30, 4] and [t for t, _, _ in top[1][0][1]][:1] == [6]


def ssh_key(raw: bytes | None) -> bool:
    """An OpenSSH private key: its magic, three strings, keys and the private part, each as long as it says."""
    magic = b"openssh-key-v1\0"
    if not raw or not raw.startswith(magic):
        return False
    at, left = len(magic), 3
    keys = None
    while left:
        if at + 4 > len(raw):
            return False
        n = int.from_bytes(raw[at : at + 4], "big")
        at += 4 + n
        left -= 1
        if at > len(raw):
            return False
        if not left and keys is None:
            if at + 4 > len(raw):
                return False
            keys = int.from_bytes(raw[at : at + 4], "big")
            at, left = at + 4, keys + 1
            if not 1 <= keys <= 16:
                return False
    return at == len(raw)


def token(header: str, payload: str) -> bool:
    parts = []
    for x in (header, payload):
        try:
            parts.append(json.loads(unbase64(x) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in parts) and isinstance(parts[0].get("alg"), str)


def spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, in order."""
    out: list[tuple[int, str, int]] = []
    lower = text.lower()
    if any(c in lower for c in _CUES):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [(m.start(), "jwt", m.end()) for m in _JWT.finditer(text) if token(m[1], m[2])]
    pem = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            raw = unbase64(_NOT_BASE64.sub("", m[3]))
            if "Proc-Type: 4,ENCRYPTED" in m[2]:  # what is encrypted fills blocks of eight bytes
                sound = m[1].endswith("PRIVATE KEY") and bool(_CIPHER.search(m[2])) and bool(raw) and len(raw) % 8 == 0
            else:
                sound = private_key(raw) or ssh_key(raw)
            if sound:
                pem.append((m.start(), "pem", m.end()))
    out += pem
    for m in _RUN.finditer(text):
        if any(a <= m.start() < b for a, _, b in pem):
            continue
        run = m[0]
        raw = bytes.fromhex(run) if len(run) % 2 == 0 and re.fullmatch(r"[0-9a-fA-F]+", run) else unbase64(run)
        if private_key(raw):
            out.append((m.start(), "key", m.end()))
        elif ssh_key(raw):
            out.append((m.start(), "ssh", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def masked(text: str, found: list[tuple[int, str, int]], mask: str = MASK) -> str:
    """The text with spans (those that overlap as one) replaced."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _apply(texts: DataFrame, fields: list[tuple[str, pa.DataType]], schema: str, make) -> DataFrame:
    """texts: text first, then columns that are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                made = [make(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array([m[i] for m in made], t) for i, (_, t) in enumerate(fields))], names=[*part.schema.names[1:], *(n for n, _ in fields)])

    return texts.mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of each row of docs (doc_id, text).

    Null and empty texts have no spans; repeated rows have theirs each; spans of different kinds may overlap;
    other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    rows = docs.select(common.text_column(docs).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    return _apply(rows, [("spans", kind)], f"doc_id long, spans {_SPANS}", lambda t: ([{"kind": k, "start": a, "end": b} for a, k, b in spans(t)],))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every span of text replaced by mask; all rows and columns stay, n_chars (if any) is counted anew. A null text becomes an empty one."""
    rest = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text"), "text string"])
    out = _apply(docs.select(common.text_column(docs).alias("text"), *(F.col(f"`{c}`") for c in rest)), [("text", pa.string())], schema, lambda t: (masked(t, spans(t), mask),))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of all documents."""
    found = find(common.table(spark, sf_dir, "documents"))
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS[:BASE]))
    of = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
