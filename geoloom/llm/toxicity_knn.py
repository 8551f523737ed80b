"""Toxicity from the nearest labelled examples, by exact TF-IDF cosine over whole texts.

A bounded sample of labelled documents (EXAMPLES of either label) is the index. All of its words are
terms. A term's weight is its frequency in the text, times the inverse of the documents of the whole
corpus that hold it, times how far the examples' labels differ over it (a log-likelihood ratio): without
the last factor the nearest examples are those of like prose, whatever they say. No term is left out.
The index is inverted, with the greatest weight that each term has in each block of examples: a block is
read only if the sum of those bounds reaches the k-th best similarity so far, so the k nearest are exact.
They vote, weighted by distance; leave-one-out votes of the examples calibrate the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.common import U

#: Labelled rows of each label that the index may hold (of more, those with the least hash of doc_id), and bytes of text that one may have.
EXAMPLES, EXAMPLE_BYTES = 1024, 1 << 15
NEIGHBOURS, BLOCK = 15, 64
THRESHOLD = 0.7
#: Added to every term's log-likelihood ratio, so that all words count; it is what words that no example has count by.
FLOOR = 0.1
#: Blocks that are read before the bounds of the others are compared, and texts that are searched for at once.
FIRST, TEXTS = 2, 128
#: Terms in more than one of so many examples are kept as a matrix, the others as lists.
DENSE = 24

_TERM = common.SpanHash(0x70C5)
_RESULT = "doc_id long, score double, evidence string"


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of each distinct word (letters, digits and marks that follow them, in lower case) of each text; null has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bare = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}\p{M}]+", " ")
    raw, offsets = common.utf8(bare)
    starts, ends, bounds = common.words(raw, offsets)
    keys, word = np.unique(_TERM.spans(raw, starts, ends), return_inverse=True)
    pairs = np.sort(np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds)) << 32 | word)
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
    return pairs[first] >> 32, keys[pairs[first] & 0xFFFFFFFF] if len(keys) else keys, np.diff(np.append(first, len(pairs)))


def _places(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in a sorted vocabulary, and whether it is there."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return place, vocabulary[place] == h


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after another, and which range each is of."""
    of = np.repeat(np.arange(len(start)), count)
    return np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + start[of], of


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a term's examples by label against those that its share in all examples expects."""
    held, n = toxic + clean, n_toxic + n_clean
    out = np.zeros(len(held))
    for seen, share in ((toxic, held * n_toxic), (clean, held * n_clean), (n_toxic - toxic, (n - held) * n_toxic), (n_clean - clean, (n - held) * n_clean)):
        at = seen > 0
        out[at] += seen[at] * np.log(seen[at] * n / share[at])
    return np.maximum(0, 2 * out)


class Index:
    """Examples as vectors of unit length in an inverted index with block maxima.

    bags: of the examples, as terms() gives them; held: documents of the corpus that hold each of vocabulary (sorted hashes).
    """

    def __init__(self, ids: list, bags: tuple[np.ndarray, np.ndarray, np.ndarray], labels: list[int], vocabulary: np.ndarray, held: np.ndarray, documents: int, weights: tuple[float, float]):
        n, y = len(ids), np.array(labels, np.int64)
        self.vocabulary, self.weight = vocabulary, np.array(weights)
        of, h, count = bags
        term, _ = _places(vocabulary, h)
        by_label = [np.bincount(term[y[of] == v], minlength=len(vocabulary)) for v in (0, 1)]
        self.factor = (np.log((1 + documents) / (1 + np.minimum(held, documents))) + 1) * (FLOOR + likelihood_ratio(by_label[1], by_label[0], int(y.sum()), int(n - y.sum())))
        self.unknown = (np.log(1 + documents) + 1) * FLOOR
        of, term, w = self._vectors(of, h, count, n)
        # examples of like content share a block, so that most blocks are far from a text: by their heaviest terms
        heavy = np.lexsort((term, -w, of))
        first = np.searchsorted(of, np.arange(n))
        size = np.diff(np.append(first, len(of)))
        top = [np.where(size > i, term[heavy][np.minimum(first + i, max(0, len(of) - 1))], -1) if len(of) else np.full(n, -1) for i in range(3)]
        order = np.lexsort((np.arange(n), *top[::-1]))
        place = np.argsort(order)
        self.ids, self.labels, self.blocks = [ids[i] for i in order.tolist()], y[order], -(-n // BLOCK)
        e = place[of]
        self.dense = np.flatnonzero(np.bincount(term, minlength=len(vocabulary)) * DENSE > n)
        self.row = np.full(len(vocabulary), -1)
        self.row[self.dense] = np.arange(len(self.dense))
        self.matrix = np.zeros((len(self.dense), self.blocks * BLOCK))
        thick = self.row[term] >= 0
        self.matrix[self.row[term[thick]], e[thick]] = w[thick]
        self.most = self.matrix.reshape(len(self.dense), self.blocks, BLOCK).max(axis=2, initial=0)
        # lists: by term, then block; a group is what a block has of a term
        thin = np.flatnonzero(~thick)
        thin = thin[np.lexsort((e[thin], term[thin]))]
        t, b = term[thin], e[thin] // BLOCK
        self.slot, self.value = (e[thin] % BLOCK).astype(np.int32), w[thin]
        new = np.flatnonzero(np.append(True, (t[1:] != t[:-1]) | (b[1:] != b[:-1]))[: len(t)])
        self.group_block, self.group_start, self.group_size = b[new], new, np.diff(np.append(new, len(t)))
        self.group_most = np.maximum.reduceat(self.value, new) if len(new) else np.zeros(0)
        self.term_start = np.searchsorted(t[new], np.arange(len(vocabulary) + 1))
        self.blank = self._rate(np.setdiff1d(np.arange(n), e))
        self.steps = self._calibrate(e, term, w)

    def _rate(self, rows: np.ndarray) -> float:
        """The share of toxic documents among these examples (all, if there are none), as of the population."""
        y = self.labels[rows] if len(rows) else self.labels
        w = self.weight[y]
        return float((w * y).sum() / w.sum()) if len(w) and w.sum() else 0.0

    def _vectors(self, of: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and weight of the words that the index knows; a text's length is over all its words."""
        term, known = _places(self.vocabulary, h)
        w = 1 + np.log(count)
        w = w * (np.where(known, self.factor[term], self.unknown) if len(self.vocabulary) else self.unknown)
        length = np.sqrt(np.bincount(of, w * w, minlength=n))
        return of[known], term[known], (w / length[of])[known]

    def similarities(self, of: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, k: int = NEIGHBOURS, every: bool = False) -> np.ndarray:
        """Of n texts to all examples, by place; -1 in blocks that cannot hold one of the k nearest (none, if every)."""
        out = np.full((n, self.blocks, BLOCK), -1.0)
        if not self.blocks:
            return out.reshape(n, 0)
        thick = self.row[term] >= 0
        common_ = np.zeros((n, len(self.dense)))
        common_[of[thick], self.row[term[thick]]] = w[thick]
        of, term, w = of[~thick], term[~thick], w[~thick]
        group, entry = _ranges(self.term_start[term], self.term_start[term + 1] - self.term_start[term])
        cell = of[entry] * self.blocks + self.group_block[group]
        bounds = common_ @ self.most + np.bincount(cell, w[entry] * self.group_most[group], minlength=n * self.blocks).reshape(n, self.blocks)
        if every or self.blocks <= FIRST:
            rounds = [np.ones((n, self.blocks), bool)]
        else:
            best = np.zeros((n, self.blocks), bool)
            np.put_along_axis(best, np.argsort(-bounds, axis=1, kind="stable")[:, :FIRST], True, 1)
            rounds = [best, None]
        for read in rounds:
            if read is None:
                flat = out.reshape(n, -1)
                least = np.partition(flat, flat.shape[1] - k, axis=1)[:, flat.shape[1] - k] if flat.shape[1] >= k else np.full(n, -1.0)
                read = ~rounds[0] & (bounds > 0) & (bounds + 1e-9 >= np.maximum(least, 0)[:, None])
            for b in np.flatnonzero(read.any(axis=0)).tolist():
                rows = np.flatnonzero(read[:, b])
                out[rows, b] = common_[rows] @ self.matrix[:, b * BLOCK : (b + 1) * BLOCK]
            use = np.flatnonzero(read.ravel()[cell])
            posting, of_group = _ranges(self.group_start[group[use]], self.group_size[group[use]])
            at = cell[use][of_group] * BLOCK + self.slot[posting]
            out += np.bincount(at, w[entry[use]][of_group] * self.value[posting], minlength=out.size).reshape(out.shape)
        # alike wherever a text stands among others: sums differ in their last digits
        return np.round(out.reshape(n, -1)[:, : len(self.ids)], 9)

    def _best(self, s: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the k nearest, nearest first, then by place."""
        n = s.shape[1]
        if n <= k:
            best = np.argsort(-s, axis=1, kind="stable")
            return best, np.take_along_axis(s, best, 1)
        key = np.round(s * 1e9).astype(np.int64) * n + (n - 1 - np.arange(n))  # ties go by place
        key = -np.sort(-np.partition(key, n - k, axis=1)[:, n - k :], axis=1)
        return n - 1 - key % n, key // n / 1e9

    def vote(self, s: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Votes of the k nearest, and of those as near as the last of them, weighted by nearness; a neighbour's label counts as much as it stands for in the population. NaN without a neighbour."""
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.zeros(len(s))
        w = np.where((s >= least[:, None]) & (s > 0), self.weight[self.labels] / (1.05 - s), 0)
        whole = w.sum(axis=1)
        return np.where(whole > 0, np.round((w * self.labels).sum(axis=1) / np.where(whole > 0, whole, 1), 9), np.nan)

    def _calibrate(self, e: np.ndarray, term: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rising steps (vote, share) fitted to the examples' leave-one-out votes: pooled adjacent violators."""
        votes = []
        for a in range(0, len(self.ids), TEXTS):
            n = min(TEXTS, len(self.ids) - a)
            own = (e >= a) & (e < a + n)
            s = self.similarities(e[own] - a, term[own], w[own], n, every=True)
            s[np.arange(n), a + np.arange(n)] = -1
            votes.append(self.vote(s))
        votes = np.concatenate(votes) if votes else np.zeros(0)
        points = sorted((v, y) for v, y in zip(votes.tolist(), self.labels.tolist(), strict=True) if v == v)
        pools: list[list[float]] = []
        for v, y in points:
            weight = float(self.weight[y])
            if pools and pools[-1][2] == v:
                pools[-1][0] += weight * y
                pools[-1][1] += weight
            else:
                pools.append([weight * y, weight, v])
        out: list[list[float]] = []
        for p in pools:
            out.append(p)
            while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
                top = out.pop()
                out[-1] = [out[-1][0] + top[0], out[-1][1] + top[1], top[2]]
        return np.array([p[2] for p in out]), np.array([p[0] / p[1] for p in out])

    def scores(self, texts: pa.Array, evidence: bool = False) -> tuple[np.ndarray, list[str]]:
        """The score of each text and, if asked for, its nearest examples with their similarities."""
        of, h, count = terms(texts)
        of, term, w = self._vectors(of, h, count, len(texts))
        out, said = np.full(len(texts), self.blank), []
        cuts = np.searchsorted(of, np.arange(0, len(texts) + TEXTS, TEXTS))
        for i, a in enumerate(range(0, len(texts), TEXTS)):
            n, own = min(TEXTS, len(texts) - a), slice(cuts[i], cuts[i + 1])
            s = self.similarities(of[own] - a, term[own], w[own], n)
            vote = self.vote(s) if s.shape[1] else np.full(n, np.nan)
            if len(self.steps[0]):
                vote = np.clip(np.interp(vote, *self.steps), 0, 1)
            found = ~np.isnan(vote)
            out[a : a + n][found] = vote[found]
            if evidence:
                best, near = self._best(s)
                said += [";".join(f"{self.ids[e]}:{self.labels[e]}:{x:.4f}" for e, x in zip(p, q, strict=True) if x > 0) for p, q in zip(best.tolist(), near.tolist(), strict=True)]
        return out, said


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label, and the words of the text as hashes and counts."""
    for batch in batches:
        of, h, count = terms(batch.column(2))
        cuts = np.searchsorted(of, np.arange(batch.num_rows + 1)).tolist()
        both = [(h[a:b].tobytes(), count[a:b].astype(np.int64).tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in both], pa.binary()) for i in (0, 1))], names=["doc_id", "toxic", "terms", "counts"])


def _holding(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in common.slices(batch):
                place, known = _places(vocabulary, terms(part.column(0))[1])
                held += np.bincount(place[known], minlength=len(vocabulary))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], names=["term", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """The index over a sample of labels (doc_id, toxic) that aren't held out; term counts are of all docs.

    Of the texts of a repeated doc_id the one with the least hash counts. The driver gets the words of the sample
    (`examples` texts of each label, EXAMPLE_BYTES each at most) and how many documents hold each of them.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("doc_id is not null")
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [own.where(F.col("toxic") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(examples) for y in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    # at most 2 * examples rows, by the limits above
    found = texts.where(F.octet_length("text") <= EXAMPLE_BYTES).join(F.broadcast(taken[0].unionByName(taken[1])), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    bags = one.select("doc_id", "toxic", "t.text").mapInArrow(_bags, "doc_id long, toxic int, terms binary, counts binary").toArrow().sort_by("doc_id")
    if len(pc.unique(bags.column("toxic"))) < 2:  # nothing to tell apart
        bags = bags.slice(0, 0)
    y, h = bags.column("toxic").to_pylist(), [np.frombuffer(x, U) for x in bags.column("terms").to_pylist()]
    of = np.repeat(np.arange(len(y)), [len(x) for x in h])
    h = np.concatenate([*h, np.zeros(0, U)])
    count = np.frombuffer(b"".join(bags.column("counts").to_pylist()), np.int64)
    vocabulary = np.unique(h)
    held = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        sums = texts.select("text").mapInArrow(_holding(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        held[sums.column("term").to_numpy()] = sums.column("n").to_numpy()
    weights = tuple(counts.get(v, 0) / max(1, y.count(v)) for v in (0, 1))
    return Index(bags.column("doc_id").to_pylist(), (of, h, count), y, vocabulary, held, texts.count(), weights)


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (doc_id:label:similarity of the nearest) of each row of docs.

    Text only is scored. A text that shares no word with an example (null and empty ones too) gets the share of
    toxic documents among examples without a word or, if there is none, among all. Without examples of both labels
    the score is 0. Examples as near as the k-th all vote. Repeated rows are scored alike; other columns are not read. Labels
    other than 0 and 1 are left out; a doc_id with both is toxic.
    """
    index = fit(docs, labels, examples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                value, said = index.scores(part.column(1), True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(value, pa.float64()), pa.array(said, pa.string())], names=["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text")).mapInArrow(run, _RESULT)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """docs, all columns, without the rows whose score reaches THRESHOLD; null and empty texts score as in score(), repeated rows alike."""
    index = fit(docs, labels, examples)
    common.text_column(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                yield part.filter(pa.array(index.scores(part.column(at))[0] < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that aren't held out."""
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
