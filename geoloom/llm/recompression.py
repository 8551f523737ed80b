"""Remove repeated passages found by recompression of the word sequences.

Rounds replace runs of one symbol, then pairs of neighbours, by new symbols. A symbol's name is a 64-bit
hash of what it stands for and the side it takes in a pair is a bit of its name, so naming is global
without a dictionary: equal stretches of words get equal symbols in every partition, but for a margin
at their ends. For each symbol the words that its parse depends on (its context) are tracked, so it is
known, not guessed, which symbols any other place with the same window of words must show as well.

Each window of `window` words is represented by one symbol whose context lies inside it: of the highest
level there is, then the longest, then the least by name. Equal windows have equal representatives. So:
 round 1  count the representatives over all documents; a window whose representative occurs once
          in all the input is unique;
 round 2  of the windows left, count the word sequences themselves (128-bit hashes), which verifies
          the repeats exactly; a sequence that is counted once is unique;
 round 3  remove every word that a window covers which is not unique.
Documents are dealt into chunks of a bounded size by a hash of their id. Only names that occur once are
sent back, each to the one chunk that has it; a passage that a third of all documents share costs one
row for each task that counts it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.common import U

WINDOW = 35
#: Rounds of naming; after r rounds a symbol stands for about (4/3)**r words, its context for about 2**r times as many.
ROUNDS = 3
#: Bytes of text that are parsed at once, which takes about 150 times as much memory.
PARSE_BYTES = 1 << 20
#: Bytes of text that a chunk holds on average, and chunks that even small inputs are dealt into.
CHUNK_BYTES = 4 << 20
LEAST_CHUNKS, ROWS_PER_CHUNK = 256, 128

_WORD = common.SpanHash(0xA11CE)
_EXACT = (common.SpanHash(0xB0B), common.SpanHash(0xCAFE))


class Level:
    """Symbols of one level: name, and the words [lo, hi) that they depend on."""

    def __init__(self, name: np.ndarray, doc: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.name, self.doc, self.start, self.lo, self.hi = name, doc, start, lo, hi

    def next(self, salt: int) -> Level:
        return self._runs(salt)._pairs(salt)

    def _runs(self, salt: int) -> Level:
        """A run of one symbol becomes one; what stands beside it must be seen to differ."""
        n = len(self.name)
        if not n:
            return self
        new = np.ones(n, bool)
        new[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        count = (last - first + 1).astype(np.uint64)
        name = np.where(count > 1, common.mix(self.name[first] * U(0x9E3779B97F4A7C15) + count + U(salt)), self.name[first])
        own_lo, own_hi = np.minimum.reduceat(self.lo, first), np.maximum.reduceat(self.hi, first)
        lo, hi = np.minimum(own_lo, self.lo[np.maximum(first - 1, 0)]), np.maximum(own_hi, self.hi[np.minimum(last + 1, n - 1)])
        # at the ends of a document a neighbour is missing, which no window can show: the context leaves the document
        doc = self.doc[first]
        at_start = (first == 0) | (self.doc[np.maximum(first - 1, 0)] != doc)
        at_end = (last == n - 1) | (self.doc[np.minimum(last + 1, n - 1)] != doc)
        return Level(name, doc, self.start[first], np.where(at_start, own_lo - (1 << 40), lo), np.where(at_end, own_hi + (1 << 40), hi))

    def _pairs(self, salt: int) -> Level:
        """A left symbol and a right one after it become one."""
        n = len(self.name)
        if n < 2:
            return self
        left = (common.mix(self.name ^ U(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)) & U(1)).astype(bool)
        same = self.doc[1:] == self.doc[:-1]
        pair = np.zeros(n, bool)
        pair[:-1] = left[:-1] & ~left[1:] & same
        second = np.zeros(n, bool)
        second[1:] = pair[:-1]
        name = self.name.copy()
        i = np.flatnonzero(pair)
        name[i] = common.mix(common.mix(self.name[i] + U(salt)) * U(0xD6E8FEB86659FD93) + self.name[i + 1])
        lo, hi = self.lo.copy(), self.hi.copy()
        hi[i] = np.maximum(self.hi[i], self.hi[i + 1])
        lo[i] = np.minimum(self.lo[i], self.lo[i + 1])
        # one that stays alone depends on the neighbour it might have paired with
        j = np.flatnonzero(left[:-1] & ~pair[:-1])
        hi[j] = np.maximum(hi[j], np.where(same[j], self.hi[j + 1], 1 << 60))
        j = np.flatnonzero(~left[1:] & ~second[1:]) + 1
        lo[j] = np.minimum(lo[j], np.where(same[j - 1], self.lo[j - 1], -(1 << 60)))
        if left[-1]:
            hi[-1] = 1 << 60
        if not left[0]:
            lo[0] = -(1 << 60)
        keep = ~second
        return Level(name[keep], self.doc[keep], self.start[keep], lo[keep], hi[keep])


def levels(h: np.ndarray, doc: np.ndarray, rounds: int) -> list[Level]:
    at = np.arange(len(h))
    out = [Level(h, doc, at, at, at + 1)]
    for r in range(1, rounds + 1):
        out.append(out[-1].next(r))
    return out


def representatives(h: np.ndarray, bounds: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes and documents' bounds in them: the first word of every window, its representative's name, and all names of symbols on the levels used, sorted."""
    n = np.diff(bounds)
    total = len(h)
    valid = np.zeros(total, bool)
    doc = np.repeat(np.arange(len(n)), n)
    valid[:] = np.arange(total) + window <= bounds[doc + 1]
    best = np.full(total + 1, ~U(0))
    open_ = valid.copy()
    named: list[np.ndarray] = []
    for rank, level in enumerate(reversed(levels(h, doc, rounds))):
        if not open_.any():
            break
        width = level.hi - level.lo
        ok = np.flatnonzero((width <= window) & (level.lo >= 0) & (level.hi <= total))
        # the level takes the three highest bits, so that representatives of different levels never meet; then longer
        # symbols come first, as they are rarer
        long = np.minimum(np.diff(np.append(level.start, total))[ok], 31).astype(np.uint64)
        name = (level.name[ok] >> U(8)) | ((U(31) - long) << U(56)) | U(rank << 61)
        first, last = np.maximum(level.hi[ok] - window, 0), level.lo[ok]
        here = _least(name, first, last, total)
        use = open_ & (here != ~U(0))
        best[:-1][use] = here[use]
        open_ &= ~use
        if use.any():
            named.append(name)
    at = np.flatnonzero(valid)
    return at, best[at], np.sort(np.concatenate(named)) if named else np.zeros(0, np.uint64)


def _least(name: np.ndarray, first: np.ndarray, last: np.ndarray, total: int) -> np.ndarray:
    """At each place the least name of the intervals [first, last] that hold it."""
    out = np.full(total, ~U(0))
    if not len(name):
        return out
    k = np.floor(np.log2(last - first + 1)).astype(np.int64)
    above = np.full(total, ~U(0))
    for step in range(int(k.max()), -1, -1):
        now = above
        for at in (first, last - (1 << step) + 1):
            np.minimum.at(now, at[k == step], name[k == step])
        if step:
            half = 1 << (step - 1)
            above = now.copy()
            np.minimum(above[half:], now[:-half], out=above[half:])
    return now


def folded(h: np.ndarray, at: np.ndarray, k: int, odd: int) -> np.ndarray:
    """A hash of the k values of h from each place in `at`: stretches of 1, 2, 4 ... values are mixed from their halves."""
    out, size = np.full(len(at), U(k)), 1
    while size <= k:
        if k & size:
            out = common.mix(out * U(odd) + h[at])
            at = at + size
        size *= 2
        if size <= k:
            h = common.mix(h[: -(size // 2)] * U(odd) + h[size // 2 :])
    return out


class Words:
    """The words of a batch of texts."""

    def __init__(self, texts: pa.Array):
        self.raw, offsets = common.utf8(texts)
        self.starts, self.ends, self.bounds = common.words(self.raw, offsets)

    def representatives(self, window: int, rounds: int):
        return representatives(_WORD.spans(self.raw, self.starts, self.ends), self.bounds, window, rounds)

    def sequences(self, at: np.ndarray, window: int) -> np.ndarray:
        """128 bits for each window that begins at one of the words `at`."""
        out = np.empty((len(at), 2), np.uint64)
        if not len(at):
            return out
        covered = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
        inside = np.cumsum(covered[:-1]) > 0
        words, place = np.flatnonzero(inside), np.cumsum(inside)[at] - 1
        for c, h in enumerate(_EXACT):
            out[:, c] = folded(h.spans(self.raw, self.starts[words], self.ends[words]), place, window, h.odd)
        return out

    def kept(self, remove: np.ndarray) -> list[bytes]:
        """Each document's words that are not removed, joined by one space."""
        keep_bytes = np.zeros(len(self.raw) + 1, np.int8)
        stay = np.flatnonzero(~remove)
        keep_bytes[self.starts[stay]] += 1
        keep_bytes[self.ends[stay]] -= 1
        inside = np.cumsum(keep_bytes[:-1]).astype(bool)
        doc = np.searchsorted(self.bounds, stay, "right") - 1
        gap = self.ends[stay[:-1]][doc[1:] == doc[:-1]]  # the byte after a word that is not its document's last is white space
        out = self.raw.copy()
        out[gap] = 0x20
        inside[gap] = True
        raw = out[inside].tobytes()
        sizes = np.zeros(len(self.bounds) - 1, np.int64)
        lengths = np.concatenate([[0], np.cumsum(self.ends[stay] - self.starts[stay])])
        first = np.searchsorted(doc, np.arange(len(sizes) + 1))
        sizes = np.diff(lengths[first]) + np.maximum(np.diff(first) - 1, 0)
        cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64) if len(column) else np.zeros(0, np.uint64)


def _names(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, limit=PARSE_BYTES):
                w = Words(part.column(1))
                at, name, names = w.representatives(window, rounds)
                new = np.flatnonzero(np.append(True, name[1:] != name[:-1])[: len(name)])
                distinct, first = np.unique(name[new], return_index=True)
                count = np.searchsorted(names, distinct, "right") - np.searchsorted(names, distinct, "left")
                doc = np.searchsorted(w.bounds, at[new[first]], "right") - 1
                chunk = part.column(0).to_numpy()[doc]  # of one that occurs once here: its only one
                yield pa.RecordBatch.from_arrays([_signed(distinct), pa.array(chunk, pa.int32()), pa.array(np.minimum(count, 2), pa.int32())], names=["name", "chunk", "n"])

    return run


def _within(name: np.ndarray, unique: np.ndarray) -> np.ndarray:
    """Which of the names are among the sorted unique ones."""
    if not len(unique):
        return np.zeros(len(name), bool)
    i = np.minimum(np.searchsorted(unique, name), len(unique) - 1)
    return unique[i] == name


def _suspects(docs: pa.Table, unique: np.ndarray, window: int, rounds: int) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    for batch in docs.combine_chunks().to_batches():
        for part in common.slices(batch, limit=PARSE_BYTES):
            w = Words(part.column(part.schema.get_field_index("text")))
            at, name, _ = w.representatives(window, rounds)
            yield part, w, at[~_within(name, unique)]


def _sequences(window: int, rounds: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32())])

    def run(docs: pa.Table, names: pa.Table) -> pa.Table:
        found = [np.zeros((0, 2), np.uint64)]
        if not len(docs):
            return schema.empty_table()
        chunk = docs.column("chunk")[0].as_py()
        unique = np.sort(_unsigned(names.column("name")))
        for _, w, at in _suspects(docs, unique, window, rounds):
            found.append(w.sequences(at, window))
        pairs, count = _distinct(np.concatenate(found))
        return pa.Table.from_arrays([_signed(pairs[:, 0].copy()), _signed(pairs[:, 1].copy()), pa.array(np.full(len(pairs), chunk), pa.int32()), pa.array(np.minimum(count, 2), pa.int32())], schema=schema)

    return run


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))
    first = np.flatnonzero(new)
    return pairs[first], np.diff(np.append(first, len(pairs)))


def _remove(window: int, rounds: int, form: str, names: list[str]):
    def run(docs: pa.Table, once: pa.Table) -> pa.Table:
        kind = np.asarray(once.column("b").is_null()) if len(once) else np.zeros(0, bool)
        unique = np.sort(_unsigned(once.column("a").filter(pa.array(kind))))
        rest = once.filter(pa.array(~kind))
        pair_a, pair_b = _unsigned(rest.column("a")), _unsigned(rest.column("b"))
        order = np.argsort(pair_a, kind="stable")
        pair_a, pair_b = pair_a[order], pair_b[order]
        # two sequences of a chunk that share the first 64 bits are told apart by the others
        known = {(a, b) for a, b in zip(pair_a.tolist(), pair_b.tolist())} if len(np.unique(pair_a)) < len(pair_a) else None
        out: list[list] = [[] for _ in names]
        extra: list[pa.Table] = []
        for part, w, at in _suspects(docs, unique, window, rounds):
            s = w.sequences(at, window)
            if known is not None:
                single = np.array([(a, b) in known for a, b in s.tolist()], bool)
            else:
                single = _within(s[:, 0], pair_a)
                if single.any():
                    single &= pair_b[np.minimum(np.searchsorted(pair_a, s[:, 0]), len(pair_a) - 1)] == s[:, 1]
            repeated = at[~single] if len(at) else at
            cover = np.zeros(len(w.starts) + 1, np.int64)
            cover[repeated] += 1
            cover[repeated + window] -= 1
            remove = np.cumsum(cover[:-1]) > 0
            kept = w.kept(remove)
            before = np.concatenate([[0], np.cumsum(remove)])
            removed = before[w.bounds[1:]] - before[w.bounds[:-1]]
            out[0] += np.diff(w.bounds).tolist()
            out[1] += removed.tolist()
            if form == "digest":
                out[2] += [hashlib.sha256(k).hexdigest() for k in kept]
            elif form == "text":
                out[2] += [k.decode("utf-8", "replace") for k in kept]
            else:  # what nothing is removed from stays as it is
                old = part.column(part.schema.get_field_index("text")).to_pylist()
                out[2] += [k.decode("utf-8", "replace") if n else t for k, n, t in zip(kept, removed.tolist(), old, strict=True)]
            extra.append(pa.Table.from_batches([part]))
        docs = pa.concat_tables(extra) if extra else docs.slice(0, 0)
        keep = docs.drop_columns([c for c in ("chunk", "text") if c in docs.column_names])
        for n, column, t in zip(names, out, (pa.int64(), pa.int64(), pa.string()), strict=True):
            keep = keep.append_column(n, pa.array(column, t))
        return keep

    return run


def chunked(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """docs with a column chunk, of which there are so many that each holds a bounded share of the text; rows without an id are spread by their text."""
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(common.text_column(docs, text)))).first()
    n = max(1, -(-int(size or 0) // CHUNK_BYTES), min(LEAST_CHUNKS, -(-rows // ROWS_PER_CHUNK)))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int")), n


def _apply(docs: DataFrame, window: int, rounds: int, form: str) -> DataFrame:
    """docs: the columns to keep, and text. Removes as remove_repeats() says.

    form: "text" adds kept_text, "digest" kept_sha256, "replace" kept_text with white space as it was where no word went.
    """
    docs, _ = chunked(docs)
    names = docs.select("chunk", "text").mapInArrow(_names(window, rounds), "name long, chunk int, n int")
    once = common.materialise(names.groupBy("name").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk")).where("n = 1").select("name", "chunk"), "names")
    # both passes over the chunks read the same columns, so that Spark deals the texts out once
    sequences = docs.groupBy("chunk").cogroup(once.groupBy("chunk")).applyInArrow(_sequences(window, rounds), "a long, b long, chunk int, n int")
    single = sequences.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk")).where("n = 1").select("a", "b", "chunk")
    both = once.select(F.col("name").alias("a"), F.lit(None).cast("long").alias("b"), "chunk").unionByName(single)
    added = ["n_words", "n_removed", "kept_sha256" if form == "digest" else "kept_text"]
    kept = [f for f in docs.schema.fields if f.name not in ("chunk", "text")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{added[0]} long", f"{added[1]} long", f"{added[2]} string"])
    return docs.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(_remove(window, rounds, form, added), schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words left, joined by one space) of each row of docs.

    A word goes if a window of `window` words that covers it starts anywhere else too, in the same document
    or another; all windows are judged on the input. Null, empty and short texts have no window and keep their
    words; repeated rows are documents of their own, so they repeat each other; without rows the result is empty.
    Other columns of docs are not read.
    """
    return _apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")), window, rounds, "text")


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """docs, all columns, with repeats removed from text; rows that no word is left of go, n_chars (if any) is counted anew. A null text becomes an empty one and stays."""
    named = docs.select(*(F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns if c != "text"), F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    out = _apply(named, window, rounds, "replace").where("n_words = 0 or n_removed < n_words")
    made = {"text": F.col("kept_text")} | ({"n_chars": F.char_length("kept_text").cast("long")} if "n_chars" in docs.columns else {})
    return out.select(*(made.get(c, F.col(f"`_{c}`")).alias(c) for c in docs.columns))


def op7_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, words removed and a digest of those kept of all documents."""
    docs = common.table(spark, sf_dir, "documents")
    return _apply(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")), WINDOW, ROUNDS, "digest")


def brute_force(texts: list[str], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """For tests: n_words, n_removed and the kept words of each text."""
    import re
    from collections import Counter

    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out
