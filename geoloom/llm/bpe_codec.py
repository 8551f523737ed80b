"""Byte-level BPE through a sentencepiece model that is written directly from the ranks of a vocabulary.

Each byte is a character of its own (so no normalisation, white space or unknown character gets in the
way), each vocabulary entry a piece whose score is its negative rank: sentencepiece then joins the pair
of lowest rank first, the leftmost of equals, as byte-level BPE does. A pre-token that is itself an entry
is that entry. Ids are ranks, so the model's piece numbers are the ids. Decoding maps ids to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.unit_cache import UnitCache

#: Byte b is written as the character of this code point plus b: letters that no normaliser is asked to touch.
FIRST_CHARACTER = 0x4E00
_TO_CHARACTERS = {b: chr(FIRST_CHARACTER + b) for b in range(256)}

_RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protocol buffer's field: a message or string, an integer, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def characters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARACTERS)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece model (public format: pieces 1, trainer 2, normaliser 3). Ranks must be 0, 1, 2 ..."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks have gaps")
    pieces = [_field(1, _field(1, characters(t).encode()) + _field(2, float(-i)) + _field(3, 1)) for i, t in enumerate(ordered)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    n = len(ordered)
    trainer = _field(3, 2) + _field(4, n + 1) + _field(40, n) + b"".join(_field(k, -1) for k in (41, 42, 43)) + _field(24, 0)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes as tiktoken does with these ranks and this pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.split = regex.compile(pattern).findall
        ordered = sorted(self.ranks, key=self.ranks.__getitem__)
        self.lengths = np.array([len(t) for t in ordered], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(ordered), np.uint8)
        # units of the cache may be cut at spaces only for patterns known to start a pre-token there
        self.cache = UnitCache(self._encode) if pattern == public_tokenizers.PATTERN else None

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and how many each has."""
        split = [[t.encode() for t in self.split(text)] for text in texts]
        known: dict[bytes, bytes] = {}
        for t in {t for s in split for t in s}:
            rank = self.ranks.get(t)
            known[t] = b"" if rank is None else struct.pack("<I", rank)
        rest = [t for t, ids in known.items() if not ids]
        for t, ids in zip(rest, self.model.encode([characters(t) for t in rest], num_threads=1) if rest else [], strict=True):
            known[t] = struct.pack(f"<{len(ids)}I", *ids)
        made = [b"".join([known[t] for t in s]) for s in split]
        return np.frombuffer(b"".join(made), "<u4"), np.array([len(m) // 4 for m in made], np.int64)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit; null has none."""
        if self.cache:
            ids, bounds = self.cache.rows(*common.utf8(texts))
        else:
            ids, counts = self._encode([t or "" for t in texts.to_pylist()])
            bounds = np.concatenate([[0], np.cumsum(counts)])
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield ids[a:b]

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _run(path: str, pattern: str, make, names: list[str], types: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in common.slices(batch):
                made = [make(own, ids) for ids in own.encode(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], names=["doc_id", *names])

    return run


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id and ids (array of int) of every text. Null and empty texts have no ids; repeated rows stay; other columns are not read."""
    types = [pa.list_(pa.int32())]
    return _documents(docs).mapInArrow(_run(vocabulary or default_vocabulary(), pattern, lambda own, ids: (ids.astype(np.int32),), ["ids"], types), "doc_id long, ids array<int>")


def digests(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the bytes that decoding them gives back. Null and empty texts have no ids; repeated rows stay; other columns are not read."""

    def make(own: Codec, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _documents(docs).mapInArrow(_run(vocabulary or default_vocabulary(), pattern, make, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()]), _RESULT)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null or no ids give an empty text. Bytes that are not UTF-8 become U+FFFD."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int64)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and what they decode to, as digests, of all documents."""
    return digests(common.table(spark, sf_dir, "documents"))
