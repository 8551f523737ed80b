"""Pack token ids of all documents into sequences, each filled to target proportions of the sources.

Every source has a queue of its documents' ids. Queues are served by deficit round-robin: in each window a
queue is credited its share of the window, serves as many whole ids as its deficit (credit less what it has
served) allows, and carries what is left into the next window. A queue that has run dry drops out, and the
others share the window in their ratios. Queues whose credit in a window would be a few ids only are served
as a group, which has a round-robin of its own: no source is cut into single ids, and none is merged with
another. As documents may be cut, the deficits at the end of a window depend on the queues' totals only
(`Round.served`), so a task works out where its ids go from the deficits carried to where they stand:
no task walks a queue, nothing loops over queues, and a source with a third of all rows is spread over as
many tasks as its rows.

Steps: (1) tokenise each input partition once into a table in the shared folder, with each document's
start in its queue within the partition; (2) sum the ids by partition and queue, and give each its
start in the whole queue; (3) cut the documents by arithmetic.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.unit_cache import UnitCache

SEQUENCE = 2048
#: A queue is served by itself if its share of a window is so many ids at least, else in a group.
LEAST_CREDIT = 64
#: Target shares of the query: as the sources' shares of all ids to this power, so that small sources weigh more.
TEMPERATURE = 0.7
#: Rows of (partition, queue) starts that may be broadcast, about 40 bytes each.
MAX_STARTS = 400_000
#: Units encoded by one call of the tokenizer.
CALL_UNITS = 4096
END_ID = 1

_TOKENS = "doc_id long, queue string, block int, block_start long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, padded_length long"


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(1)
def _cache(path: str) -> tuple[UnitCache, str]:
    """A cache before the tokenizer of a file, and the type its ids are stored as."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocabulary = tokenizer.get_vocab()
    most = max(vocabulary.values(), default=0)
    spaced = np.zeros(most + 1, bool)
    for token, i in vocabulary.items():
        spaced[i] = token.startswith("Ġ")  # the byte-level alphabet's space
    special = tuple(t.content.encode() for t in tokenizer.get_added_tokens_decoder().values())

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(m) for m in made], np.int64)
        return np.fromiter((i for m in made for i in m), np.uint32, int(counts.sum())), counts

    def encode_spaced(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = ["".join(units[i : i + CALL_UNITS]) for i in range(0, len(units), CALL_UNITS)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        begin = np.flatnonzero(spaced[ids])
        return (ids, np.diff(np.append(begin, len(ids)))) if len(begin) == len(units) else encode(units)

    return UnitCache(encode, encode_spaced, special), "<u2" if most < 65536 else "<u4"


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, stored = _cache(path)
        block, starts = TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in common.slices(batch):
                ids, bounds = cache.rows(*common.utf8(part.column(2)))
                ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                counts, at = np.diff(bounds), []
                for q, n in zip(part.column(1).to_pylist(), counts.tolist(), strict=True):
                    at.append(starts.get(q, 0))
                    starts[q] = at[-1] + n
                raw = ids.astype(stored)
                offsets = (bounds * raw.itemsize).astype(np.int64)
                binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(counts), block), pa.int32()), pa.array(at, pa.int64()), pa.array(counts, pa.int64()), binary], names=[f.split()[0] for f in _TOKENS.split(", ")])

    return run


def _share(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """floor(a * b / c), exactly, for 0 <= b <= c < 2**61 and 0 <= a < 2**50; the product may wrap around."""
    out = np.floor(a * (b / c)).astype(np.int64)
    return out + (a * b - out * c) // c


class Round:
    """Deficit round-robin over queues of known totals: a stream in which each window holds each queue's share.

    Queues are kept in the order in which they run dry, last one first, so that those still served are the first
    ones. `served` is how many ids a queue has served up to a place: its credit so far, rounded so that the
    queues' numbers add up. Credit and service differ by less than one id, which is the deficit carried.
    """

    def __init__(self, totals: list[int], weights: list[int], window: int):
        order = sorted(range(len(totals)), key=lambda q: (-Fraction(totals[q], weights[q]), q))
        self.place = np.argsort(np.array(order, np.int64))
        n, w = [totals[q] for q in order], [weights[q] for q in order]
        self.window, self.total = window, sum(n)
        self.upto = np.concatenate([[0], np.cumsum(np.array(w, np.int64))])
        self.after = np.append(np.cumsum(np.array(n[::-1], np.int64))[::-1], 0)
        # where each queue runs dry, rounded up: a falling sequence
        dry = [-(-n[i] * int(self.upto[i + 1]) // w[i]) + int(self.after[i + 1]) for i in range(len(n))]
        self.dry = -np.array(dry, np.int64)

    def before(self, t: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Ids of the first i queues (in the order in which they are kept) up to place t."""
        live = np.searchsorted(self.dry, -t, "left")
        some = np.maximum(live, 1)
        out = _share(t - self.after[live], self.upto[np.minimum(i, live)], self.upto[some])
        return np.where(i >= live, t - self.after[i], out)

    def served(self, t: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.before(t, i + 1) - self.before(t, i)

    def deficit(self, k: int) -> list[Fraction]:
        """What each queue that is not dry carries out of window k - 1: credit less service. For tests and reports."""
        t = min(k * self.window, self.total)
        live = int(np.searchsorted(self.dry, -t, "left"))
        credit = Fraction(t - int(self.after[live]), int(self.upto[max(live, 1)]))
        own = [credit * int(self.upto[i + 1] - self.upto[i]) - int(self.served(np.array([t]), np.array([i]))[0]) for i in range(live)]
        return [own[i] if i < live else Fraction(0) for i in self.place.tolist()]

    def _window_of(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The window in which id p of queue i is served."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), -(-self.total // self.window))
        while (high - low > 1).any():
            middle = (low + high) // 2
            done = self.served(np.minimum(middle * self.window, self.total), i) <= p
            low, high = np.where(done, middle, low), np.where(done, high, middle)
        return low

    def put(self, queue: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For stretches [lo, hi) of queues: the pieces they are cut into, as number of the stretch, lo, hi, and place in the stream."""
        i = self.place[queue]
        first = self._window_of(i, lo)
        count = self._window_of(i, hi - 1) - first + 1
        of = np.repeat(np.arange(len(lo)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
        i, t, u = i[of], k * self.window, np.minimum((k + 1) * self.window, self.total)
        ahead, done = self.before(t, i), self.served(t, i)
        a, b = np.maximum(lo[of], done), np.minimum(hi[of], self.served(u, i))
        return of, a, b, t + self.before(u, i) - ahead + a - done


class Schedule:
    """The rounds of all queues: of those that are served by themselves, and of groups of the others."""

    def __init__(self, totals: list[int], weights: list[int], window: int = SEQUENCE, least: int = LEAST_CREDIT):
        self.totals, self.weights, self.window, self.fan = totals, weights, window, max(2, window // least)
        self.rounds: list[Round] = []
        self.up: list[tuple[int, int]] = []  # a round's own place: (round above, number in it)
        self.at = np.zeros((len(totals), 2), np.int64)  # a queue's
        if totals:
            self._build(list(range(len(totals))))

    def _build(self, queues: list[int]) -> int:
        """Make the round of some queues and those below it; returns its number."""
        whole = sum(self.weights[q] for q in queues)
        own = [[q] for q in queues if self.weights[q] * self.fan >= whole]
        small = [q for q in queues if self.weights[q] * self.fan < whole]
        rest, window = sum(self.weights[q] for q in small), self.window
        if small and rest * self.fan < whole:
            # the small ones together are owed a few ids in a window: a longer window for the two parts
            own = [[q for g in own for q in g], small]
            while window * rest < self.window // self.fan * whole:
                window *= 2
        elif small:
            groups, weight = [[]], 0
            for q in small:
                if weight * self.fan >= whole:
                    groups.append([])
                    weight = 0
                groups[-1].append(q)
                weight += self.weights[q]
            if weight * self.fan < whole and len(groups) > 1:
                last = groups.pop()
                groups[-1] += last
            own += groups
        number = len(self.rounds)
        self.rounds.append(Round([sum(self.totals[q] for q in g) for g in own], [sum(self.weights[q] for q in g) for g in own], window))
        self.up.append((-1, 0))
        for i, g in enumerate(own):
            if len(g) == 1:
                self.at[g[0]] = number, i
            else:
                self.up[self._build(g)] = number, i
        return number

    def put(self, queue: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For stretches [lo, hi) of queues: their pieces, as number of the stretch, lo, hi, and place among all ids."""
        done = [np.zeros((4, 0), np.int64)]
        # of the stretches: which, from where, to where, place in the round's stream and length there
        waiting = {r: [] for r in range(len(self.rounds))}
        for r in np.unique(self.at[queue, 0]).tolist():
            own = np.flatnonzero(self.at[queue, 0] == r)
            waiting[r].append((own, lo[own], self.at[queue[own], 1], lo[own], hi[own]))
        for r in reversed(range(len(self.rounds))):  # rounds below have higher numbers
            if not waiting[r]:
                continue
            of, start, child, a, b = (np.concatenate(x) for x in zip(*waiting[r], strict=True))
            piece, c, d, place = self.rounds[r].put(child, a, b)
            begin = start[piece] + c - a[piece]
            up, number = self.up[r]
            if up < 0:
                done.append(np.stack([of[piece], begin, begin + d - c, place]))
            else:
                waiting[up].append((of[piece], begin, np.full(len(piece), number), place, place + d - c))
        return tuple(np.concatenate(done, axis=1))


def _cut(names: list[str], schedule: Schedule, length: int, stored: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = {q: i for i, q in enumerate(names)}, sum(schedule.totals)
        for batch in batches:
            for part in common.slices(batch, "ids", 1 << 20):
                doc_ids, queues, ids = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4)
                p, n = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
                doc, lo, hi, at = schedule.put(np.array([index[q] for q in queues], np.int64), p, p + n)
                # a piece may stand across the end of a sequence
                count = (at + hi - lo - 1) // length - at // length + 1
                piece = np.repeat(np.arange(len(doc)), count)
                edge = (at // length)[piece] + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
                begin, end = np.maximum(at[piece], edge * length), np.minimum((at + hi - lo)[piece], (edge + 1) * length)
                doc, lo, hi, at = doc[piece], (lo - at)[piece] + begin, (lo - at)[piece] + end, begin
                order = np.lexsort((lo, doc))
                doc, lo, hi, at = doc[order], lo[order], hi[order], at[order]
                fresh = np.ones(len(doc), bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (hi - lo)[:-1]) | (at[1:] % length == 0)
                begin = np.flatnonzero(fresh)
                end = np.append(begin[1:], len(doc)) - 1
                doc, lo, hi, at = doc[begin], lo[begin], hi[end], at[begin]
                start = lo - p[doc]
                crc, raw, last_doc = [], b"", -1
                for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (hi - p[doc])).tolist(), strict=True):
                    if d != last_doc:
                        raw, last_doc = memoryview(np.frombuffer(ids[d].as_buffer(), stored).astype("<u4")).cast("B"), d
                    crc.append(zlib.crc32(raw[a:b]))
                filled = np.minimum(total - at // length * length, length)
                padded = np.minimum(2 ** np.ceil(np.log2(filled)).astype(np.int64), length)
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), *(pa.array(x, pa.int64()) for x in (start, hi - lo, crc, n[doc], at // length, at % length)), part.column(1).take(of), pa.array(padded, pa.int64())], names=[f.split()[0] for f in _PIECES.split(", ")])

    return run


def whole_weights(weights: list[float]) -> list[int]:
    """Weights as whole numbers that add up to about 2**40, each at least 1."""
    scale = (1 << 40) / sum(weights)
    return [max(1, round(w * scale)) for w in weights]


def pack(docs: DataFrame, vocabulary: str | None = None, weights: dict[str, float] | None = None, temperature: float = 1.0, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document of docs (doc_id, text, source; other columns are not read).

    weights: target share of each source in every sequence, while its queue lasts (then the others keep their
    ratios; sources that are owed less than LEAST_CREDIT ids of a sequence share a group's place, in which theirs
    is held over more sequences). None: the sources' shares of all ids to the power `temperature`; at 1 all queues
    last to the end. All ids are packed whatever the weights. The driver holds a row for each source.
    A null or empty text is the end id alone; a null source counts as ''. Repeated rows are packed each; without
    rows the result is empty. Pieces of a document that stand side by side are one piece. A special token's string
    in a text gives that token's id, as the library does by default.
    """
    if sequence < 2 * LEAST_CREDIT:
        raise ValueError(f"a sequence needs {2 * LEAST_CREDIT} ids at least")
    path = vocabulary or default_vocabulary()
    queue = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), common.text_column(docs).alias("text"))
    tokens = common.materialise(rows.mapInArrow(_tokenise(path, end_id), _TOKENS), "tokens")
    sums = common.materialise(tokens.groupBy("queue", "block").agg(F.sum("doc_tokens").alias("n")), "sums")
    totals = sorted((r.queue, r.n) for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    names, counts = [q for q, _ in totals], [n for _, n in totals]
    if weights is not None and (lacking := [q for q in names if weights.get(q, 0) <= 0]):
        raise ValueError(f"sources without a weight: {lacking[:5]}")
    shares = whole_weights([weights[q] if weights is not None else n**temperature for q, n in totals]) if weights is not None or temperature != 1 else counts
    schedule = Schedule(counts, shares, sequence)
    before = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("queue", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = tokens.join(common.broadcast_if_small(starts, sums.count(), MAX_STARTS), ["queue", "block"])
    return placed.select("doc_id", "queue", (F.col("base") + F.col("block_start")).alias("p"), "doc_tokens", "ids").mapInArrow(_cut(names, schedule, sequence, _cache(path)[1]), _PIECES)


def op2_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed to the sources' shares to the power TEMPERATURE."""
    return pack(common.table(spark, sf_dir, "documents"), temperature=TEMPERATURE)
