"""Shared pieces of the training-data operators: tables, scratch storage, batches of text, word hashes."""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds at once; a longer text is a step of its own.
SLICE_BYTES = 2 << 20

#: Rows of an Arrow batch: Spark's default of 10,000 texts is held several times over, beside the heap.
BATCH_ROWS = 1024
#: Bytes of text after which a Python worker, which lives on between tasks, gives freed memory back.
RELEASE_BYTES = 32 << 20

U = np.uint64
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share. Where none is named, a local one, if Spark runs in one process (as in tests); else it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/geoloom-scratch-{os.getpid()}"
    return f"{root.rstrip('/')}/geoloom/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def written() -> int:
    """How many tables this process has written so far and not cleaned."""
    return len(_written)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables that this process has written to the shared folder after the first `since`, but for the last `keep`, once no result that reads them is needed."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for at in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """Mark df for a broadcast if its counted rows are within limit; beyond it Spark joins by a shuffle."""
    return F.broadcast(df) if rows <= limit else df


#: A key with more rows than this is hot; hot keys that may be broadcast, about 50 bytes each.
HOT_ROWS, MAX_HOT = 256, 200_000


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], n: str) -> DataFrame:
    """rows joined with the one row that table has for each of their keys; n: table's column of how many rows a key has.

    Keys with more than HOT_ROWS rows get theirs by a broadcast, so that no task has all rows of one; the others by a
    shuffle. Beyond MAX_HOT hot keys none of them holds much of the whole, and all are shuffled.
    """
    hot = materialise(table.where(F.col(n) > HOT_ROWS), "hot")
    if not 0 < hot.limit(MAX_HOT + 1).count() <= MAX_HOT:
        return rows.join(table, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col(n) <= HOT_ROWS), keys)
    return rest.unionByName(rows.join(F.broadcast(hot), keys))


def text_column(df: DataFrame, text: str = "text"):
    """The text as a string, null as empty. Also has the session hand texts to Python in small batches, unless it sets their size itself."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


_seen = 0


def release(n: int = RELEASE_BYTES) -> None:
    """Count n bytes as done with; give freed memory back to the system from time to time."""
    global _seen
    _seen += n
    if _seen >= RELEASE_BYTES:
        _seen = 0
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most limit bytes of the column, or a single row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > start:
            yield batch.slice(start, i - start)
            total, start = 0, i
        total += n
    yield batch.slice(start)
    release(int(sizes.sum()))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows in them; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array, "").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1 + array.offset)[array.offset :]
    data = array.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+ and, per row, the index of its first word (n + 1 values)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class SpanHash:
    """64-bit hashes of byte spans: eight bytes at a time are mixed into a state that begins with the length.

    Each step is a non-linear bijection of the state, so no arrangement of bytes cancels as it would in a
    polynomial. Spans beyond LONG bytes are hashed by BLAKE2, a call each. Nothing is kept between calls.
    """

    LONG = 128
    _MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

    def __init__(self, seed: int):
        self.seed, self.odd = (int(x) for x in np.random.default_rng(seed).integers(0, 2**64, 2, dtype=np.uint64))
        self.odd |= 1

    def spans(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(raw) + 1, "<u8", padded.data, strides=(1,))
        odd, n = U(self.odd), ends - starts
        h = mix((eight[starts] & self._MASKS[np.minimum(n, 8)]) * odd + n.astype(np.uint64) + U(self.seed))
        rest = np.flatnonzero((n > 8) & (n <= self.LONG))
        at, left = starts[rest] + 8, n[rest] - 8
        while len(rest):
            h[rest] = mix((h[rest] ^ U(self.seed)) * odd + (eight[at] & self._MASKS[np.minimum(left, 8)]))
            more = left > 8
            rest, at, left = rest[more], at[more] + 8, left[more] - 8
        key = self.seed.to_bytes(8, "little")
        for i in np.flatnonzero(n > self.LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
        return h


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive values of h (len(h) - k + 1 values), in order."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = mix(out * U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return out
