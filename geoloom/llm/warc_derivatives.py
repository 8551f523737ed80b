"""WARC derivatives: from each response record a metadata record (headers, title, links) and a plain-text conversion record.

Both name the response they come from (WARC-Refers-To), keep its target, date and payload digest, and have
digests of their own; the metadata record keeps the response's WARC and HTTP headers and names the conversion
it belongs to. Headers are kept in order, repeated ones too, and looked up in any case; transfer and content
codings are undone before text and links are taken. Records are whole and in the public format (WARC 1.1), so those of a partition, one after
another, each a gzip member, are a .warc.gz file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common

VERSION = b"WARC/1.1"
#: When pages without a date count as fetched.
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:geoloom:warc")

_RESPONSE = "page_id long, record binary"
_DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, payload_digest string, n_links long, record binary, error string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def identifier(*parts: str) -> str:
    """A record id that follows from what the record is, so that a task that runs again makes the same record."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}".encode() for k, v in headers), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Headers and block of one record; raises ValueError if its form, length or block digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _fields(x.decode("utf-8", "replace") for x in lines[1:])
    try:
        n = int(first(headers, "Content-Length") or "-1")
    except ValueError:
        n = -1
    if n < 0 or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block's length is wrong")
    if (said := first(headers, "WARC-Block-Digest")) and said.lower().startswith("sha1:") and said.lower() != digest(rest[:n]).lower():
        raise ValueError("the block's digest is wrong")
    return headers, rest[:n]


def _fields(lines: Iterable[str]) -> list[tuple[str, str]]:
    """Header lines as pairs, in order; a line that begins with white space continues the one before."""
    out: list[tuple[str, str]] = []
    for line in lines:
        name, _, value = line.partition(":")
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif line:
            out.append((name.strip(), value.strip()))
    return out


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    """The value of the first header of a name, in any case."""
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _unchunked(raw: bytes) -> bytes:
    """The payload of a chunked body; as it is, if its form is wrong."""
    out, at = [], 0
    while True:
        end = raw.find(b"\r\n", at)
        try:
            n = int(raw[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            n = -1
        if n < 0 or end + 2 + n > len(raw):
            return raw
        if not n:
            return b"".join(out)
        out.append(raw[end + 2 : end + 2 + n])
        at = end + 2 + n + 2


def decoded(raw: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, list[str]]:
    """A body without its transfer and content codings, and those that could not be undone."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        raw = _unchunked(raw)
    coded = [x.strip().lower() for k, v in headers if k.lower() == "content-encoding" for x in v.split(",") if x.strip()]
    for i, coding in reversed(list(enumerate(coded))):
        if coding == "identity":
            continue
        try:
            if coding in ("gzip", "x-gzip"):
                raw = gzip.decompress(raw)
            elif coding == "deflate":
                raw = zlib.decompress(raw, zlib.MAX_WBITS if raw[:1] and raw[0] & 15 == 8 else -zlib.MAX_WBITS)
            else:
                return raw, coded[: i + 1]
        except (OSError, EOFError, zlib.error):
            return raw, coded[: i + 1]
    return raw, []


_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|title|head|body|html|dd|dt|dl|form|hr|td|th|option)\b[^<>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_TITLE = re.compile(r"<title\b[^<>]*>(.*?)(?:</title|<|\Z)", re.S | re.I)
_LINK = re.compile(r"""<(a|img|link|script|iframe|area)\b[^<>]*?\b(href|src)\s*=\s*(?:"([^"<>]*)"|'([^'<>]*)'|([^\s<>"']+))""", re.I)
_BLANK = re.compile(r"[^\S\n]+")


def text_of(page: str) -> str:
    """The visible text, a line for each block element, blank lines left out."""
    page = _TAG.sub("", _BREAK.sub("\n", _DROP.sub("", page)))
    lines = (x.strip() for x in _BLANK.sub(" ", html.unescape(page)).split("\n"))
    return "\n".join(x for x in lines if x)


def links_of(page: str, base: str) -> list[dict[str, str]]:
    """Links in order, resolved against the page's address where that is possible."""
    out = []
    for m in _LINK.finditer(page):
        raw = html.unescape(m[3] or m[4] or m[5] or "").strip()
        try:
            url = urljoin(base, raw)
        except ValueError:
            url = raw
        out.append({"path": f"{m[1].upper()}@/{m[2].lower()}", "url": url})
    return out


def response(page_id: int | None, url: str, page: str, date: str = DATE) -> bytes:
    payload = page.encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", str(page_id), url, digest(payload))), ("WARC-Date", date), ("WARC-Target-URI", url)]
    return record([*headers, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")], block)


def derive(raw: bytes) -> list[tuple]:
    """(type, id, refers-to, target, block digest, payload digest, links, record) of a response's two derivatives; none of other records."""
    headers, block = parse(raw)
    if (first(headers, "WARC-Type") or "").lower() != "response":
        return []
    source = first(headers, "WARC-Record-ID")
    if not source:
        raise ValueError("the record has no identifier")
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *lines = head.decode("latin-1").split("\r\n")
    http = _fields(lines)
    charset = re.search(r"charset=[\"']?([\w.:-]+)", first(http, "Content-Type") or "", re.I)
    body, left = decoded(payload, http)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    if left:  # bytes of an unknown coding are no text
        page = ""
    url, date = first(headers, "WARC-Target-URI") or "", first(headers, "WARC-Date") or DATE
    paid = first(headers, "WARC-Payload-Digest") or digest(payload)
    title = _TITLE.search(page)
    links = links_of(page, url)
    conversion_id, metadata_id = identifier("conversion", source), identifier("metadata", source)
    envelope = {"warc": headers, "http": {"status": status, "headers": http}, "payload": {"length": len(payload), "digest": paid, "codings_left": left}, "html": {"title": html.unescape(title[1]).strip() if title else "", "links": links}, "conversion": conversion_id}
    made = (("metadata", metadata_id, "application/json", json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode()), ("conversion", conversion_id, "text/plain; charset=utf-8", text_of(page).encode()))
    out = []
    for kind, name, content, body in made:
        h = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", source), ("WARC-Date", date), ("WARC-Target-URI", url)]
        h += [("WARC-Source-Payload-Digest", paid), ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        if kind == "metadata":
            h.append(("WARC-Concurrent-To", conversion_id))
        out.append((kind, name, source, url, digest(body), paid, len(links), record(h, body)))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id and record (a response record) of each row of pages (page_id, url, html); null url and html are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                made = [response(i, u, t, date) for i, u, t in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["page_id", "record"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), common.text_column(pages, "html").alias("text"))
    return rows.mapInArrow(run, _RESPONSE)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response in records (page_id, record).

    A page without text, or in a coding that can't be undone, has an empty conversion. Records of other types are
    passed over. A null record and bytes that are no record give one row of type "error" that says why in `error`
    (null in other rows) and has nulls otherwise. Equal rows have equal records, ids included; other columns are not read.
    """

    def made(page: int | None, raw: bytes | None) -> list[tuple]:
        try:
            if raw is None:
                raise ValueError("there is no record")
            return [(page, *x, None) for x in derive(raw)]
        except ValueError as e:
            return [(page, "error", *[None] * 5, 0, None, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _DERIVED.split(", ")]
        types = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for part in common.slices(batch, "record"):
                rows = [x for i, r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in made(i, r)]
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in rows], t) for k, t in enumerate(types)], names=names)

    return records.select(F.col("page_id").cast("long").alias("page_id"), "record").mapInArrow(run, _DERIVED)


def member(raw: bytes) -> bytes:
    """A record as a gzip member: members one after another are a .warc.gz file."""
    return gzip.compress(raw, 6, mtime=0)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the derivatives of all pages' responses."""
    found = derivatives(responses(common.table(spark, sf_dir, "pages")))
    return found.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "block_digest", "payload_digest", "n_links", F.octet_length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
