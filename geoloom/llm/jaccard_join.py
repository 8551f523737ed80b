"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Steps:
 1  A document's distinct shingles are hashed to 64 bits; of them come a digest of the set, 128 MinHash
    values and 32 bands of four. Documents with equal sets are a class of copies; one represents it.
 2  Bands that one representative alone has are dropped. The others are buckets. A bucket that holds more
    than TILE documents is cut into tiles, and pairs of tiles go to different tasks.
 3  In a bucket, MinHash values are compared 16 at a time. After each step a pair is dropped when the
    posterior probability (uniform prior) that its similarity reaches the threshold falls below EPSILON.
    What is left is kept as a spanning forest, so a bucket gives fewer rows than it has documents.
 4  Components of those forests hold every pair that was left. Within a component (in tiles, if it is
    large) the sets themselves are compared, exactly. Each document gets its count of links, and the
    exact links give the classes.
A pair at the threshold shares no band with probability (1 - 0.8**4)**32 < 5e-8.
No step makes a row for each pair, and none collects a group in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import common
from geoloom.llm.common import U

SHINGLE = 5
THRESHOLD = 0.8
HASHES, BAND = 128, 4
#: MinHash values compared between two looks at the posterior.
STEP = 16
#: A pair is dropped when the probability that it reaches the threshold is below this.
EPSILON = 1e-5
#: Documents that are compared with each other in one group, and about how many rows of groups one call is given.
TILE = 512
CELL_ROWS = 1024
#: Buckets up to this size are compared pair by pair, larger ones as a search for a spanning forest.
SMALL = 12
#: Documents, and bytes of their sets, of a tile of a component whose sets are compared; those of two tiles are in one call.
LINK_TILE, LINK_BYTES = 512, 8 << 20
#: Representatives in candidate components whose numbers may be broadcast, 48 bytes each.
MAX_CANDIDATES = 200_000

_WORD = common.SpanHash(0x5EED)
_rng = np.random.default_rng(0x313)
_MULTIPLY = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**64, HASHES, dtype=np.uint64)

_FEATURES = "doc_id long, set_a long, set_b long, size int, signature binary"
_BAND_BYTES = HASHES // BAND * 8


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted. A text of fewer words is one shingle, one without words has none."""
    raw, offsets = common.utf8(texts)
    starts, ends, bounds = common.words(raw, offsets)
    h = _WORD.spans(raw, starts, ends)
    w = common.windows(h, k) if len(h) >= k else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(w[a : b - k + 1]))
        elif b > a:
            out.append(common.windows(h[a:b], b - a) ^ U(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set that isn't empty."""
    out = np.full(HASHES, ~U(0))
    step = max(1, (1 << 17) // HASHES)
    for i in range(0, len(shingles), step):
        x = shingles[i : i + step, None] * _MULTIPLY[None, :] + _ADD[None, :]
        x ^= x >> U(32)
        np.minimum(out, (x * U(0x9E3779B97F4A7C15)).min(axis=0), out=out)
    return out


def least_matches(threshold: float, epsilon: float) -> list[tuple[int, int]]:
    """For each number of compared values, the matches with which a pair stays.

    With a uniform prior, m of n matches give a Beta(m + 1, n - m + 1) posterior; P(s >= t) is then the
    chance of at most m successes in n + 1 trials of t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= epsilon:
                break
            m += 1
        out.append((n, m))
    return out


def _keys(values: np.ndarray) -> bytes:
    """What is kept of a signature: a 64-bit key for each band, then the lowest byte of each value."""
    bands = values.reshape(-1, BAND)
    key = np.arange(len(bands), dtype=np.uint64)
    for i in range(BAND):
        key = common.mix(key * U(0x9E3779B97F4A7C15) + bands[:, i])
    return key.tobytes() + (values & U(255)).astype(np.uint8).tobytes()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices(batch):
            sets = shingle_sets(part.column(1))
            digests = [_digest(s) for s in sets]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            known: dict[bytes, bytes | None] = {}
            for s, d in zip(sets, digests, strict=True):
                if d not in known:
                    known[d] = _keys(signature(s)) if len(s) else None
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(halves[:, i].copy(), pa.int64()) for i in (0, 1)), pa.array([len(s) for s in sets], pa.int32()), pa.array([known[d] for d in digests], pa.binary())],
                names=["doc_id", "set_a", "set_b", "size", "signature"],
            )


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = np.frombuffer(b"".join(x[:_BAND_BYTES] for x in batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), HASHES // BAND), pa.int64()), pa.array(keys, pa.int64())], names=["node", "band"])


class Forest:
    """Disjoint sets of 0 .. n - 1, each named by its least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _spanning(signatures: np.ndarray, tile: np.ndarray, rules: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that stay; between documents of different tiles only, if there are two."""
    edges, forest = [], Forest(len(signatures))
    rest = np.arange(len(signatures))
    queue: list[int] = []
    two = bool(tile.any() and not tile.all())
    waiting = set(range(len(signatures)))
    while waiting:
        i = queue.pop() if queue else min(waiting)
        waiting.discard(i)
        rest = rest[rest != i]
        near = rest[tile[rest] != tile[i]] if two else rest
        matches, done = np.zeros(len(near), np.int64), 0
        for n, least in rules:
            if not len(near):
                break
            matches = matches + (signatures[near, done:n] == signatures[i, done:n]).sum(axis=1)
            stay = matches >= least
            near, matches, done = near[stay], matches[stay], n
        for j in near.tolist():
            if forest.join(i, j):
                edges.append((i, j))
                queue.append(j)
        if len(near) and not two:
            rest = np.setdiff1d(rest, near, assume_unique=True)
        queue = [q for q in queue if q in waiting]
    return edges


def _pairwise(values: np.ndarray, a: np.ndarray, b: np.ndarray, rules: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows a and b that stay."""
    matches, done = np.zeros(len(a), np.int64), 0
    for n, least in rules:
        matches = matches + (values[a, done:n] == values[b, done:n]).sum(axis=1)
        stay = matches >= least
        a, b, matches, done = a[stay], b[stay], matches[stay], n
    return a, b


def _groups(table: pa.Table, *keys: str) -> Iterator[np.ndarray]:
    """Row numbers of each group of equal keys."""
    columns = [table.column(k).to_numpy() for k in keys]
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    yield from np.split(order, np.flatnonzero(new)[1:])


def _candidates(rules: list[tuple[int, int]]):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(cell: pa.Table) -> pa.Table:
        nodes, side = cell.column("node").to_numpy(), cell.column("side").to_numpy() > 0
        values = np.frombuffer(b"".join(x[_BAND_BYTES:] for x in cell.column("signature").to_pylist()), np.uint8).reshape(-1, HASHES)
        pairs, found = {}, [np.zeros((0, 2), np.int64)]
        for rows in _groups(cell, "band", "t", "u"):
            if len(rows) <= SMALL:
                pairs.setdefault(len(rows), []).append(rows)
            else:
                found.append(rows[np.array(_spanning(values[rows], side[rows], rules), np.int64).reshape(-1, 2)])
        for n, groups in pairs.items():
            i, j = np.triu_indices(n, 1)
            at = np.stack(groups)
            a, b = at[:, i].ravel(), at[:, j].ravel()
            found.append(np.stack(_pairwise(values, a, b, rules), axis=1))
        edges = np.sort(nodes[np.concatenate(found)], axis=1)
        edges = np.unique(edges, axis=0) if len(edges) else edges
        common.release()
        return pa.Table.from_arrays([pa.array(edges[:, 0].copy(), pa.int64()), pa.array(edges[:, 1].copy(), pa.int64())], schema=schema)

    return run


def tiled(members: DataFrame, key: str, counts: DataFrame, salt_on: str, tiles: Column | None = None) -> DataFrame:
    """members of groups of two or more, once for each pair of tiles (t, u) they belong to; side is 1 in the second.

    counts has key and n, the members of each group, and comes from an aggregation of them. tiles: into how many a group is cut.
    """
    tiles = F.ceil(F.col("n") / TILE) if tiles is None else tiles
    table = counts.where("n > 1").select(key, tiles.cast("int").alias("tiles"), "n")
    placed = common.spread_join(members, table, [key], "n").drop("n").withColumn("own", F.pmod(F.xxhash64(salt_on), F.col("tiles")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return pairs.select("*", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), (F.col("own") > F.col("other")).cast("int").alias("side")).drop("tiles", "own", "other")


def in_cells(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """rows with a column cell, the same for a group's rows; a cell holds some thousand of the n rows, or one group."""
    return rows.withColumn("cell", F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-n // CELL_ROWS)))).cast("int"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """node and root (the least node of its component) for the nodes of edges (a, b), by rounds of large and small stars.

    Each round writes its edges to the shared folder; their number never grows.
    """
    both = lambda e: e.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(e.select(F.col("b").alias("x"), F.col("a").alias("y")))
    edges = common.materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    last = None
    while True:
        around = both(edges)
        # large star: neighbours above a node go to the least of the node and its neighbours
        least = around.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n")).select("x", F.least("x", "m").alias("m"), "n")
        large = common.spread_join(around.where("y > x"), least, ["x"], "n").select(F.col("m").alias("a"), F.col("y").alias("b")).distinct()
        # small star: a node and its lesser neighbours go to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select("m", F.explode(F.array_distinct(F.array("a", "b"))).alias("v")).where("m < v").distinct().select(F.col("m").alias("a"), F.col("v").alias("b"))
        edges = common.materialise(small, name)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
        last = state


def _overlaps(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the first sets shares with each of the second."""
    out = np.zeros((len(first), len(second)), np.float32)
    both = [(np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate(x)) for x in (first, second)]
    shared = np.intersect1d(both[0][1], both[1][1])
    if not len(shared):
        return out
    sides = []
    for owner, values in both:
        place = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        own = np.flatnonzero(shared[place] == values)
        own = own[np.argsort(place[own], kind="stable")]
        sides.append((owner[own], place[own]))
    width = 4096
    for a in range(0, len(shared), width):
        x, y = (np.zeros((len(sets), width), np.float32) for sets in (first, second))
        for m, (owner, place) in zip((x, y), sides, strict=True):
            lo, hi = np.searchsorted(place, (a, a + width))
            m[owner[lo:hi], place[lo:hi] - a] = 1
        out += x @ y.T
    return out


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of representatives: of rows with the class's doc_id, those that have the class's set."""
    for batch in batches:
        for part in common.slices(batch):
            sets = shingle_sets(part.column(0))
            want = [part.column(i).to_numpy() for i in (1, 2)]
            halves = np.frombuffer(b"".join(map(_digest, sets)), np.int64).reshape(-1, 2)
            own = np.flatnonzero((halves[:, 0] == want[0]) & (halves[:, 1] == want[1]))
            rest = part.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in (3, 4, 5)), pa.array([sets[i].tobytes() for i in own.tolist()], pa.binary())], names=["node", "root", "copies", "shingles"])


def _links(threshold: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    top = round(threshold * 10_000)

    def run(cell: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        nodes, side, copies = (cell.column(c).to_numpy() for c in ("node", "side", "copies"))
        t, u = cell.column("t").to_numpy(), cell.column("u").to_numpy()
        shingles = cell.column("shingles")
        for rows in _groups(cell, "root", "t", "u"):
            two = t[rows[0]] != u[rows[0]]
            parts = [rows[side[rows] == 0], rows[side[rows] == 1]] if two else [rows, rows]
            links, forest, place = np.zeros(len(nodes), np.int64), Forest(len(rows)), {r: i for i, r in enumerate(rows.tolist())}
            for i in range(0, len(parts[0]), TILE):
                x = parts[0][i : i + TILE]
                mine = [np.frombuffer(shingles[r].as_py(), np.uint64) for r in x.tolist()]
                for j in range(0 if two else i, len(parts[1]), TILE):
                    y = parts[1][j : j + TILE]
                    same = not two and i == j
                    theirs = mine if same else [np.frombuffer(shingles[r].as_py(), np.uint64) for r in y.tolist()]
                    both = _overlaps(mine, theirs).astype(np.float64)
                    sizes = np.add.outer([len(s) for s in mine], [len(s) for s in theirs])
                    # whole numbers on both sides: the threshold is met or not, without rounding
                    linked = (both * 10_000 >= top * (sizes - both)) & (both > 0)
                    if same:
                        np.fill_diagonal(linked, False)
                    else:
                        links[y] += copies[x] @ linked
                    links[x] += linked @ copies[y]
                    for a, b in zip(*np.nonzero(np.triu(linked) if same else linked), strict=True):
                        if forest.join(place[int(x[a])], place[int(y[b])]):
                            out.append((int(nodes[x[a]]), int(nodes[y[b]]), 0))
            out += [(n, n, k) for n, k in zip(nodes[rows].tolist(), links[rows].tolist(), strict=True) if k]
        common.release()
        return pa.Table.from_pylist([dict(zip(("a", "b", "links"), x, strict=True)) for x in out], schema=schema)

    return run


def join(docs: DataFrame, threshold: float = THRESHOLD, epsilon: float = EPSILON) -> DataFrame:
    """doc_id, class_id, copies_id, n_copies and n_links of each row of docs (doc_id, text; others are not read).

    copies_id: the least doc_id among documents with the same set of shingles, n_copies their number;
    class_id: the least doc_id that can be reached by links; n_links: other rows whose similarity reaches
    the threshold, copies included. A text of one to four words is a single shingle, so it links to equal ones
    only. Null and empty texts have no shingles and no links: each is its own class. Rows with the same doc_id
    are documents of their own (a null doc_id comes after others). A similarity of just the threshold links.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    features = common.materialise(rows.mapInArrow(_features, _FEATURES), "features")
    classes = features.where("size > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("signature").alias("signature"))
    classes = common.materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    rules = least_matches(threshold + (1 - threshold) / 256, epsilon)  # bytes of different values may be equal
    bands = classes.select("node", "signature").mapInArrow(_bands, "node long, band long")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = common.materialise(tiled(bands, "band", sizes, "node"), "members")
    members = in_cells(members.join(classes.select("node", "signature"), "node"), members.count(), "band", "t", "u")
    candidates = components(members.groupBy("cell").applyInArrow(_candidates(rules), "a long, b long"), "candidates")

    chosen = common.materialise(candidates.join(classes.select("node", "doc_id", "set_a", "set_b", "copies", "size"), "node"), "chosen")
    n = chosen.count()
    texts = rows.join(common.broadcast_if_small(chosen, n, MAX_CANDIDATES), rows["doc_id"].eqNullSafe(chosen["doc_id"]))
    sets = texts.select("text", "set_a", "set_b", "node", "root", "copies").mapInArrow(_sets, "node long, root long, copies long, shingles binary").dropDuplicates(["node"])
    counts = chosen.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    groups = tiled(sets, "root", counts, "node", F.ceil(F.greatest(F.col("n") / LINK_TILE, F.col("size") * 8 / LINK_BYTES)))
    verified = in_cells(groups, n * 4, "root", "t", "u").groupBy("cell").applyInArrow(_links(threshold), "a long, b long, links long")
    verified = common.materialise(verified, "verified")

    links = verified.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    reached = components(verified.where("a < b or a > b").select("a", "b"), "classes")
    least = reached.join(classes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    named = common.spread_join(reached, least, ["root"], "n").select("node", "class_id")
    known = classes.drop("signature", "size").join(named, "node", "left").join(links, "node", "left")
    known = known.select("set_a", "set_b", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("doc_id").alias("copies_id"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = common.materialise(known, "known")
    rows = features.select("doc_id", "set_a", "set_b", "size")
    out = common.spread_join(rows.where("size > 0"), known, ["set_a", "set_b"], "copies").unionByName(rows.where("size = 0"), allowMissingColumns=True)
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copies_id", "doc_id").alias("copies_id"), F.coalesce("copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, with one row of each class of links: that of the least doc_id (rows without one come last; of equals any one).

    Rows are told apart by themselves, whatever their doc_id: two rows of one doc_id are compared like any others.
    Null and empty texts have no links, so all of those rows stay; without rows the result is empty.
    """
    keyed = common.materialise(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.monotonically_increasing_id().alias("row")), "rows")
    links = common.materialise(join(keyed.select(F.col("row").alias("doc_id"), F.col("own.text").alias("text")), threshold).select(F.col("doc_id").alias("row"), "class_id", "n_links").where("n_links > 0"), "joined")
    named = links.join(keyed.select("row", F.col("own.doc_id").alias("doc_id")), "row")
    kept = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    gone = common.materialise(links.select("row").join(kept, "row", "left_anti"), "gone")
    return keyed.join(common.broadcast_if_small(gone, gone.count(), MAX_CANDIDATES), "row", "left_anti").select(*(F.col("own")[c].alias(c) for c in docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of all documents."""
    return join(common.table(spark, sf_dir, "documents"))


def brute_force(texts: list[str], threshold: float = THRESHOLD) -> set[tuple[int, int]]:
    """For tests: pairs of row numbers whose similarity reaches the threshold."""
    import re
    from fractions import Fraction

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    limit = Fraction(round(threshold * 10_000), 10_000)
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (both := len(sets[i] & sets[j])) and Fraction(both, len(sets[i] | sets[j])) >= limit}
