"""Vector code compression: product codes whose codebooks are trained by filtering Lloyd rounds over kd-trees.

Every component x becomes the integer floor(4096 * x); a vector is cut into ``PARTS`` equal consecutive parts; each part
position has a codebook of at most ``ENTRIES`` entries. From here on all arithmetic is on integers, so results do not
depend on how rows are dealt, and ties are ties.

1. Every partition packs its vectors into blocks of at most ``BLOCK`` and builds, per block and part position, a balanced
   kd-tree: at each level a node's points are halved along its widest dimension. A node caches its bounding box, the sum of
   its points and (by its place) their count. Blocks are written once to the shared checkpoint folder.
2. A round reads the blocks and walks down each tree level by level with the entries that each node may still need. The
   entry nearest to a box's middle eliminates every other entry that is farther from all of the box; a node left with one
   entry is assigned whole through its cached sum and count, and only points of undecided leaves are compared one by one.
   An entry at equal distance is eliminated only if its index is the larger one, so ties go to the lower index as they
   would point by point. Sums and counts per entry are added up by Spark; the driver gets one row an entry and position in
   its part, and replaces entries by floor(sum / count). Unused entries stay.
3. The last walk assigns every point and gives its squared distance.

Codebooks start as the parts of the 16 smallest kept ids (nulls last, ties by the vector); fewer rows give fewer entries.

Dropped: null vectors, those with null or non-finite components, and those whose length is not that of the smallest kept
id's vector, or no positive multiple of ``PARTS``. Integers beyond 2**62 count as that. Repeated rows are rows of their
own; an empty table gives an empty result; further columns are not read. ``error`` and ``label_error`` beyond a long
count as the largest long. No row, label or block meets another in a task: labels are summed by a grouping and their sums
are looked up (broadcast if there are at most ``LABELS_BROADCAST``, else joined on the label and a salt).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import keep_plan_short, with_small_batches

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
#: Vectors of a block, and points of a kd-tree's leaf at most.
BLOCK, LEAF = 4096, 8
#: Integers up to this one are handled as int64, larger ones (up to FARTHEST) as Python's.
NARROW, FARTHEST = 1 << 24, 1 << 62
LABELS_BROADCAST, SALTS = 100_000, 32
LONGEST = 2**63 - 1

BLOCK_SCHEMA = "packed binary"
SUM_SCHEMA = "part int, entry int, place int, total decimal(38,0), n long"
CODE_SCHEMA = "vec_id long, label string, code string, error decimal(38,0)"


def as_integers(x: np.ndarray) -> np.ndarray:
    """floor(4096 * x), int64 if all are small, else exact Python integers."""
    scaled = np.floor(x.astype(np.float64) * SCALE)  # a power of two: exact, or infinite beyond the range of doubles
    if not scaled.size or np.abs(scaled).max() <= NARROW:
        return scaled.astype(np.int64)
    clipped = [max(-FARTHEST, min(FARTHEST, int(v))) if np.isfinite(v) else (FARTHEST if v > 0 else -FARTHEST) for v in scaled.ravel().tolist()]
    return np.array(clipped, object).reshape(scaled.shape)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(-1)


class Tree:
    """A balanced kd-tree: node j of level l holds the places j*n>>l up to (j+1)*n>>l of ``order``."""

    def __init__(self, points: np.ndarray) -> None:
        n = self.n = len(points)
        self.depth = max(0, (max(n, 1) // LEAF).bit_length() - 1)
        self.order = np.arange(n)
        self.low, self.high, self.total = [], [], []
        for level in range(self.depth + 1):
            cuts = self.cuts(level)
            mine = points[self.order]
            low, high = np.minimum.reduceat(mine, cuts[:-1]), np.maximum.reduceat(mine, cuts[:-1])
            self.low.append(low)
            self.high.append(high)
            self.total.append(np.add.reduceat(mine, cuts[:-1]))
            if level < self.depth:
                node = np.repeat(np.arange(len(low)), np.diff(cuts))
                widest = np.argmax(high - low, axis=1)
                along = mine[np.arange(n), widest[node]]
                self.order = self.order[np.lexsort((along, node))]
        self.points = points[self.order]

    def cuts(self, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1) * self.n) >> level

    def walk(self, book: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
        """(level, nodes, entry of each, None) for nodes assigned whole; (depth, nodes, None, candidates) for open leaves."""
        nodes, may = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for level in range(self.depth + 1):
            low, high = self.low[level][nodes], self.high[level][nodes]
            # Distances to the middle only choose the entry to compare with; doubled, they stay integers.
            far = _distances((low + high)[:, None, :], 2 * book[None]).astype(np.float64)
            near = np.argmin(np.where(may, far, np.inf), axis=1)
            best = book[near]
            corner = np.where(book[None] > best[:, None, :], high[:, None, :], low[:, None, :])
            behind = _distances(corner, book[None]) - _distances(corner, best[:, None, :])
            may = may & ~((behind > 0) | ((behind == 0) & (np.arange(len(book)) > near[:, None])))
            may[np.arange(len(nodes)), near] = True
            alone = may.sum(axis=1) == 1
            yield level, nodes[alone], near[alone], None
            nodes, may = nodes[~alone], may[~alone]
            if not len(nodes):
                return
            if level == self.depth:
                yield level, nodes, None, may
            else:
                nodes, may = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(may, 2, axis=0)

    def _leaf_points(self, nodes: np.ndarray, may: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the leaves' points, their nearest candidates and the squared distances."""
        cuts = self.cuts(self.depth)
        size = cuts[nodes + 1] - cuts[nodes]
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(cuts[nodes], size)
        far = _distances(self.points[place][:, None, :], book[None])
        far = np.where(np.repeat(may, size, axis=0), far, far.max(axis=1, keepdims=True) + 1)
        entry = np.argmin(far, axis=1)
        return place, entry, far[np.arange(len(place)), entry]

    def sums(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per entry the sum and the number of the points nearest to it."""
        total, count = np.zeros(book.shape, self.points.dtype), np.zeros(len(book), np.int64)
        for level, nodes, entry, may in self.walk(book):
            if may is None:
                cuts = self.cuts(level)
                np.add.at(total, entry, self.total[level][nodes])
                np.add.at(count, entry, cuts[nodes + 1] - cuts[nodes])
            else:
                place, entry, _ = self._leaf_points(nodes, may, book)
                np.add.at(total, entry, self.points[place])
                np.add.at(count, entry, 1)
        return total, count

    def nearest(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per point, in the order given, its nearest entry and the squared distance."""
        out, far = np.zeros(self.n, np.int64), np.zeros(self.n, self.points.dtype)
        for level, nodes, entry, may in self.walk(book):
            if may is None:
                cuts = self.cuts(level)
                size = cuts[nodes + 1] - cuts[nodes]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(cuts[nodes], size)
                entry = np.repeat(entry, size)
                out[place], far[place] = entry, _distances(self.points[place], book[entry])
            else:
                place, entry, distance = self._leaf_points(nodes, may, book)
                out[place], far[place] = entry, distance
        entry, distance = np.empty_like(out), np.empty_like(far)
        entry[self.order], distance[self.order] = out, far
        return entry, distance


def _packed(ids: list, labels: list, vectors: np.ndarray) -> pa.RecordBatch:
    points = as_integers(vectors)
    width = points.shape[1] // PARTS
    trees = [Tree(points[:, p * width : (p + 1) * width]) for p in range(PARTS)]
    for tree in trees:
        tree.order = tree.order.astype(np.uint16)
        if tree.points.dtype != object:  # as narrow as they are
            kind = np.int16 if not tree.n or np.abs(tree.points).max() < 1 << 15 else np.int32
            tree.points = tree.points.astype(kind)
            tree.low, tree.high, tree.total = [x.astype(kind) for x in tree.low], [x.astype(kind) for x in tree.high], [x.astype(np.int64) for x in tree.total]
    blob = zstandard.compress(pickle.dumps((ids, labels, trees), protocol=5), 1)
    return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["packed"])


def _unpacked(blob: bytes) -> tuple[list, list, list[Tree]]:
    """Only blocks that this module has written are read."""
    ids, labels, trees = pickle.loads(zstandard.decompress(blob))
    for tree in trees:
        tree.order = tree.order.astype(np.int64)
        if tree.points.dtype != object:
            tree.points, tree.low, tree.high = tree.points.astype(np.int64), [x.astype(np.int64) for x in tree.low], [x.astype(np.int64) for x in tree.high]
    return ids, labels, trees


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list = []
    labels: list = []
    parts: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            piece = batch.slice(at, BLOCK)
            if len(ids) + piece.num_rows > BLOCK:
                yield _packed(ids, labels, np.concatenate(parts))
                ids, labels, parts = [], [], []
            ids += piece.column("vec_id").to_pylist()
            labels += piece.column("label").to_pylist()
            parts.append(piece.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(piece.num_rows, -1))
    if ids:
        yield _packed(ids, labels, np.concatenate(parts))


def _books(vectors: list[list[float]]) -> list[np.ndarray]:
    points = as_integers(np.array(vectors, np.float64))
    width = points.shape[1] // PARTS
    return [points[:, p * width : (p + 1) * width] for p in range(PARTS)]


def _same_kind(book: np.ndarray, tree: Tree) -> tuple[np.ndarray, Tree]:
    """Narrow integers if both sides are; Python's otherwise."""
    if tree.points.dtype == object or book.dtype == object:
        tree.points, tree.low, tree.high, tree.total = tree.points.astype(object), [x.astype(object) for x in tree.low], [x.astype(object) for x in tree.high], [x.astype(object) for x in tree.total]
        return book.astype(object), tree
    return book, tree


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if book.dtype == object and all(abs(v) <= NARROW for v in book.ravel().tolist()) else book


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """vec_id, vector (doubles or floats) and label of the rows that are kept."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above infinity
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label")).where(F.col("vector").isNotNull() & good & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).collect()
    return kept.where(F.size("vector") == (first[0]["n"] if first else 0))


def train_codebooks(kept: DataFrame, blocks: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks by part position, after all rounds."""
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    books = _books([list(r["vector"]) for r in start]) if start else []
    for _ in range(rounds if books else 0):

        def work(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            totals = [[np.zeros(b.shape, object), np.zeros(len(b), np.int64)] for b in books]
            for batch in batches:
                for blob in batch.column("packed"):
                    for p, tree in enumerate(_unpacked(blob.as_py())[2]):
                        total, count = Tree.sums(*_same_kind(books[p], tree)[::-1])
                        totals[p][0] += total.astype(object)
                        totals[p][1] += count
            rows = [(p, e, d, int(total[e, d]), int(count[e])) for p, (total, count) in enumerate(totals) for e in np.flatnonzero(count).tolist() for d in range(total.shape[1])]
            yield _sum_rows(rows)

        summed = blocks.mapInArrow(work, SUM_SCHEMA).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        new = [b.astype(object) for b in books]
        for r in summed.collect():  # at most ENTRIES rows a component
            new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [_narrow(b) for b in new]
    return books


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    from decimal import Decimal

    part, entry, place, total, n = zip(*rows, strict=True) if rows else ((),) * 5
    arrays = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0)), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["part", "entry", "place", "total", "n"])


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "vector", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """One row a kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    from decimal import Decimal

    with_small_batches(vectors.sparkSession)
    kept = usable(vectors, vec_id, vector, label)
    blocks = keep_plan_short(kept.mapInArrow(_pack, BLOCK_SCHEMA))
    books = train_codebooks(kept, blocks, rounds)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("packed"):
                ids, labels, trees = _unpacked(blob.as_py())
                codes, error = [], np.zeros(len(ids), object)
                for book, tree in zip(books, trees, strict=True):
                    entry, distance = Tree.nearest(*_same_kind(book, tree)[::-1])
                    codes.append(entry.tolist())
                    error += distance.astype(object)
                code = ["".join(f"{c:02x}" for c in row) for row in zip(*codes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(code, pa.string()), pa.array([Decimal(min(LONGEST, int(e))) for e in error], pa.decimal128(38, 0))], ["vec_id", "label", "code", "error"])

    coded = keep_plan_short(blocks.mapInArrow(encode, CODE_SCHEMA))
    sums = keep_plan_short(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= LABELS_BROADCAST:
        joined = coded.join(F.broadcast(sums.withColumnRenamed("label", "of")), F.col("label").eqNullSafe(F.col("of")))
    else:
        salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
        spread = sums.withColumnRenamed("label", "of").withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = coded.withColumn("salt", salt).join(spread, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("of_salt")))
    as_long = lambda c: F.least(F.col(c), F.lit(LONGEST).cast("decimal(38,0)")).cast("long").alias(c)
    return joined.select("vec_id", "code", as_long("error"), as_long("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
