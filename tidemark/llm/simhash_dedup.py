"""SimHash near-deduplication: fingerprints linked within a Hamming radius through BK-trees of shards.

A fingerprint bit is one if more than half of a text's shingles (word n-grams of the text with A-Z lower-cased,
repeats included, joined by spaces; a shorter text is one shingle; a text without words has fingerprint zero) have that
bit in their hash. Hashes are XXH64 with seed 42; ``words`` > 1 extends the fingerprint to several longs, each from the
hash remixed.

Links are sought between distinct fingerprints only, so exact copies never form pairs. A shard is the set of
fingerprints that agree on all bits of a mask. Each shard builds a BK-tree (children keyed by their Hamming distance
to the parent) and searches it for its own members, following only edges within the radius of the distance to the
node. ``exact_masks`` are so chosen that any two fingerprints within the radius meet in some shard: 64 bits are cut
into ``blocks`` bytes, any two fingerprints with r differing bits agree on blocks - r of them. A shard then has
64 - 8 * (blocks - r) free bits only: with radius 2, at most 2**16 members, of which at most 137 lie within the radius
of any other. So a shard has a proven bound, and no hot bucket exists to be split.

The trees are dealt to their shards by a shuffle instead of being broadcast: broadcasting would send all fingerprints
to the driver, which grows with the corpus.

Very long texts are hashed whole, one at a time, in memory that grows with the text. Null texts are like empty ones; null doc_ids count as documents but never name a component (a component of such rows
only has a null id); repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_windows import mixed
from tidemark.llm.frames import free_name, keep_plan_short, map_slices, texts_of, with_small_batches
from tidemark.llm.links import components

SEED = 42
#: Searches of a tree go forward so many members at a time, which bounds the frontier's memory.
SEARCH_BLOCK = 4096


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, in order."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray, words: int = 1) -> list[int]:
    """``words`` signed longs: the bits set in over half of the hashes."""
    out = []
    for i in range(words):
        h = hashes if i == 0 else mixed(hashes, salt=i)
        ones = np.concatenate([np.bincount(h.view(np.uint8)[b::8], minlength=256) @ _BYTE_BITS for b in range(8)])
        bits = np.packbits((2 * ones > len(h)), bitorder="little")
        out.append(int(bits.view(np.int64)[0]))
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint array<long>."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [majority(shingle_hashes(t, shingle), words) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return map_slices(docs.select("doc_id", "text"), work, "doc_id long, fingerprint array<long>")


def exact_masks(radius: int, blocks: int = 8) -> list[list[int]]:
    """Masks (one long each, signed) of which any two 64-bit fingerprints within the radius share one."""
    width = 64 // blocks
    block = [((1 << width) - 1) << (width * i) for i in range(blocks)]
    masks = [sum(c) for c in combinations(block, blocks - radius)]
    return [[m - (1 << 64) if m >> 63 else m] for m in masks]


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the magnitude's bits


def bk_trees(points: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Build one BK-tree for each run of equal ``tree`` numbers, all at once, level by level.

    Returns parent (-1 for roots) and edge (distance to the parent) of every point. The first point of a run is its
    root; points that arrive at a node over the same distance go under the first of them.
    """
    n, far = len(points), 64 * points.shape[1] + 1
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    first = np.concatenate([[True], tree[1:] != tree[:-1]])
    node = np.flatnonzero(first)[np.cumsum(first) - 1]
    loose = np.flatnonzero(~first)
    while len(loose):
        d = _distance(points[loose], points[node[loose]])
        _, start, group = np.unique(node[loose] * far + d, return_index=True, return_inverse=True)
        child = loose[start]
        parent[child], edge[child] = node[child], d[start]
        node[loose] = child[group]
        placed = np.zeros(len(loose), bool)
        placed[start] = True
        loose = loose[~placed]
    return parent, edge


def bk_search(points: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance), i > j, within the radius in the same tree, in blocks of searching points."""
    n, far = len(points), 64 * points.shape[1] + 1
    parent, edge = bk_trees(points, tree)
    order = np.argsort(parent * far + edge, kind="stable")
    keys = (parent * far + edge)[order]
    first = np.concatenate([[True], tree[1:] != tree[:-1]])
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    for at in range(0, n, SEARCH_BLOCK):
        query = np.arange(at, min(n, at + SEARCH_BLOCK))
        node = root[query]
        while len(query):
            d = _distance(points[query], points[node])
            near = (d <= radius) & (node < query)
            if near.any():
                yield query[near], node[near], d[near]
            low = np.searchsorted(keys, node * far + np.maximum(d - radius, 0), side="left")
            high = np.searchsorted(keys, node * far + np.minimum(d + radius, far - 1), side="right")
            counts = high - low
            query = np.repeat(query, counts)
            step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            node = order[np.repeat(low, counts) + step]


def joined_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of every point the lowest point it is connected to) after the points i[k] and j[k] are connected too."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while ((up := label[label]) != label).any():
            label = up
    return label


def _links(radius: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                members = whole.slice(at, 2048).column("members")
                ids = np.asarray(members.flatten().field(0))
                points = np.asarray(members.flatten().field(1).flatten()).reshape(-1, words)
                sizes = np.asarray(members.value_lengths())
                tree = np.repeat(np.arange(len(sizes)), sizes)
                label = np.arange(len(ids))
                for i, j, _ in bk_search(points, tree, radius):
                    label = joined_labels(label, i, j)
                mine = np.flatnonzero(label < np.arange(len(ids)))
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(ids[label[mine]])], ["a", "b"])

    return run


def near_links(prints: DataFrame, masks: list[list[int]], radius: int, words: int = 1) -> DataFrame:
    """``prints`` (id long, fingerprint array<long>), both distinct, to links (a, b) with the components
    of all pairs within the radius that meet in a shard.

    Nearness isn't transitive, so every pair of a shard is joined in the shard's task, and each member is then linked to
    the first member it is connected to there: one link a member at most. A link's own ends may be further apart.
    """
    masked: list[Column] = [F.struct(F.lit(i).alias("mask"), *[F.get("fingerprint", F.lit(w)).bitwiseAND(F.lit(m[w]).cast("long")).alias(f"part_{w}") for w in range(words)]) for i, m in enumerate(masks)]
    # Few bytes, but each row becomes as many as there are masks: a number of partitions keeps them in all tasks, by a key
    # of its own, since a shuffle by the id alone would be taken for the one before.
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("id", F.lit(1)))
    shards = spread.select("id", "fingerprint", F.explode(F.array(*[F.xxhash64(m) for m in masked])).alias("shard"))
    full = shards.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("id", "fingerprint"))).alias("members")).where(F.size("members") > 1)
    return full.select("members").mapInArrow(_links(radius, words), "a long, b long").where(F.col("a") != F.col("b")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    prints = keep_plan_short(fingerprints(docs, shingle).select("doc_id", F.get("fingerprint", F.lit(0)).alias("print")))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first_doc"))
    links = near_links(classes.select(F.col("print").alias("id"), F.array("print").alias("fingerprint")), exact_masks(radius), radius)
    rooted = components(links).select(F.col("node").alias("print"), "root")
    labelled = classes.join(rooted, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_print = labelled.join(least, "root").select("print", "component_id")
    out = prints.join(of_print, "print")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by sets of five-word shingles: fingerprints linked through BK-trees and verified first, then an exact search for
# the pairs of that Jaccard similarity whose 64 bits differ by more than a small radius.

SHINGLE = 5
#: Bits within which the fingerprints of two sets are linked.
RADIUS = 2
#: Members of a bucket that one join key holds on its left side; of a larger bucket every part meets all members.
SHARD_MEMBERS = 2000
#: Shingles in that many texts of one in COMMON_SAMPLE come last in the order; at most COMMON_LIMIT are broadcast.
COMMON_SAMPLE, COMMON_TEXTS, COMMON_LIMIT = 64, 4, 200_000
#: A list of so many texts to verify is still broadcast.
VERIFIED_TEXTS = 50_000
#: A list of so many (id, hash) pairs to drop is still broadcast, so that texts are not shuffled.
DROPPED_ROWS = 200_000
#: Prefix shingles that one unit (a packed row of many texts) and one part (a range of shingle hashes) hold.
UNIT_TOKENS, PART_TOKENS = 4_000_000, 2_000_000
#: Bytes of a shingle hash that are compared between texts. A collision only adds a pair that the exact test rejects.
TOKEN_BYTES = 6
ROW_SCHEMA = "doc_id long, text_hash long, id long, n long, bits binary, print long"
UNIT_SCHEMA = "unit long, n_tokens long, known binary, doc_id binary, text_hash binary, id binary, n binary, bits binary, prints binary, tokens binary"


def prefix_size(n: int, similarity: float) -> int:
    """How many of a set's n shingles, first in a common order, no set of that similarity can miss altogether."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def _places(n: int) -> int:
    return 64 << max(0, (4 * n).bit_length() - 7)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of the parity of the hashes in each of its places: a power of two of them, two to four a hash.

    Two bitmaps differ in at most as many places as the sets have elements that are not common to both; of a bitmap
    twice as long the halves are first folded by exclusive or.
    """
    places = _places(len(hashes))
    odd = np.bincount((hashes >> np.uint64(16)).astype(np.int64) % places, minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def places_apart(a: bytes, b: bytes) -> int:
    """In how many places two bitmaps differ; a longer one is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def _shingle_set(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def _whole_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = pa.array([_shingle_set(t).tobytes() for t in texts_of(batch)], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column("id"), sets], ["id", "shingles"])


def _common_shingles(keyed: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample of the distinct texts, sorted. They only decide the order of shingles."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_shingle_set(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64), pa.int64())], ["token"])

    sample = keyed.where(F.pmod(F.xxhash64("text_hash"), F.lit(COMMON_SAMPLE)) == 0).select("text", "text_hash").dropDuplicates(["text_hash"])
    counted = map_slices(sample, work, "token long").groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_TEXTS)
    return np.sort(np.array([r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(COMMON_LIMIT).select("token").collect()], np.int64).view(np.uint64))


def _is_in(ordered: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.searchsorted(ordered, hashes, side="right") > np.searchsorted(ordered, hashes, side="left")


def _low_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES]).tobytes()


def _from_low_bytes(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // TOKEN_BYTES, 8), np.uint8)
    out[:, :TOKEN_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, TOKEN_BYTES)
    return out.view(np.uint64).ravel()


def _units(keyed: DataFrame, similarity: float) -> DataFrame:
    """Every text's set in packed rows: its id, size, parity bitmap, fingerprint and the prefix in the order (common or not, hash)."""
    common = keyed.sparkSession.sparkContext.broadcast(_common_shingles(keyed))
    with_small_batches(keyed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held = TaskContext.get().partitionId() << 32, 0, 0
        ids, hashes, sets, sizes, bits, prints, tokens = [], [], [], [], [], [], []

        def unit() -> pa.RecordBatch:
            nonlocal ids, hashes, sets, sizes, bits, prints, tokens, made, held
            known = np.array([i is not None for i in ids])
            blobs = [np.packbits(known), np.array([i or 0 for i in ids], np.int64), np.array(hashes, np.int64), np.array(sets, np.int64), np.array(sizes, np.int32), np.concatenate(bits), np.array(prints, np.int64)]
            row = [pa.array([task + made]), pa.array([held]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([_low_bytes(np.concatenate(tokens))], pa.binary())]
            ids, hashes, sets, sizes, bits, prints, tokens, made, held = [], [], [], [], [], [], [], made + 1, 0
            return pa.RecordBatch.from_arrays(row, [c.split()[0] for c in UNIT_SCHEMA.split(", ")])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch), strict=True):
                    found = _shingle_set(text)
                    late = _is_in(common.value, found)
                    first = np.concatenate([found[~late], found[late]])[: prefix_size(len(found), similarity)]
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    sets.append(_set_id(found))
                    sizes.append(len(found))
                    bits.append(parity(found))
                    prints.append(majority(found)[0])
                    tokens.append(first >> np.uint64(64 - 8 * TOKEN_BYTES))
                    held += len(first)
                    if held >= UNIT_TOKENS:
                        yield unit()
        if ids:
            yield unit()

    return keyed.select("doc_id", F.col("text_hash"), "text").mapInArrow(run, UNIT_SCHEMA)


def _rows_of_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(whole.num_rows):
            r = whole.slice(k, 1).to_pylist()[0]
            n = np.frombuffer(r["n"], np.int32)
            known = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=len(n)).astype(bool)
            ends = np.concatenate([[0], np.cumsum([_places(x) // 8 for x in n.tolist()])]).astype(np.int32)
            bits = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(r["bits"])])
            longs = lambda name, r=r: np.frombuffer(r[name], np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(longs("doc_id"), mask=~known), pa.array(longs("text_hash")), pa.array(longs("id")), pa.array(n.astype(np.int64)), bits, pa.array(longs("prints"))], [c.split()[0] for c in ROW_SCHEMA.split(", ")])
            for at in range(0, len(n), 4096):
                yield batch.slice(at, 4096)


class _Prefixes:
    """The distinct sets of a unit and their prefix shingles; ``distinct`` shingles in order, ``of`` maps to them."""

    def __init__(self, row: dict, similarity: float, parts: int) -> None:
        n, tokens = np.frombuffer(row["n"], np.int32), _from_low_bytes(row["tokens"])
        lengths = np.array([prefix_size(x, similarity) for x in n.tolist()], np.int64)
        starts = np.cumsum(lengths) - lengths
        ids, first = np.unique(np.frombuffer(row["id"], np.int64), return_index=True)
        once = np.repeat(np.bincount(first, minlength=len(n)).astype(bool), lengths)
        self.tokens, self.set = tokens[once], np.repeat(np.arange(len(n)), lengths)[once]
        self.place = (np.arange(len(tokens)) - np.repeat(starts, lengths))[once]
        self.ids, self.sizes = np.frombuffer(row["id"], np.int64), n
        self.distinct, self.of, counts = np.unique(self.tokens, return_inverse=True, return_counts=True)
        self.several = counts > 1
        self.part = ((self.distinct >> np.uint64(8 * TOKEN_BYTES - 32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _shared_shingles(units: DataFrame, similarity: float) -> DataFrame:
    """token, id, n, place (in the common order) of the prefix shingles that two units or two sets of one have.

    Every unit sends its distinct shingles, packed, to the parts of the hash range and gets a bit for each one back: a
    shingle of very many texts travels once a unit, and what no second text has never becomes a row.
    """
    total = units.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    least = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(least, total // 1000), -(-total // PART_TOKENS))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                row = whole.slice(k, 1).to_pylist()[0]
                own = _Prefixes(row, similarity, parts)
                cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(own.part)), bool), own.part[1:] != own.part[:-1]]))
                ends = [*cuts[1:].tolist(), len(own.part)]
                tokens = [_low_bytes(own.distinct[a:b]) for a, b in zip(cuts.tolist(), ends, strict=False)]
                several = [np.packbits(own.several[a:b]).tobytes() for a, b in zip(cuts.tolist(), ends, strict=False)]
                if len(cuts):
                    yield pa.RecordBatch.from_arrays([pa.array(own.part[cuts]), pa.array([row["unit"]] * len(cuts), pa.int64()), pa.array(tokens, pa.binary()), pa.array(several, pa.binary())], ["part", "unit", "tokens", "several"])

    def settle(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        tokens = [_from_low_bytes(r["tokens"]) for r in rows]
        several = np.concatenate([np.unpackbits(np.frombuffer(r["several"], np.uint8), count=len(t)) for r, t in zip(rows, tokens, strict=True)])
        _, of, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        shared = (counts > 1) | (np.bincount(of, weights=several) > 0)
        bits = [np.packbits(x).tobytes() for x in np.split(shared[of], np.cumsum([len(t) for t in tokens])[:-1])]
        return pa.table([pa.array([r["unit"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int64()), pa.array(bits, pa.binary())], names=["unit", "part", "shared"])

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        for row in left.to_pylist():
            own, answer = _Prefixes(row, similarity, parts), {r["part"]: r["shared"] for r in right.to_pylist()}
            sizes = np.bincount(own.part, minlength=parts)
            bits = [np.unpackbits(np.frombuffer(answer[p], np.uint8), count=sizes[p]) for p in np.flatnonzero(sizes).tolist()]
            met = np.concatenate(bits).astype(bool)[own.of] if bits else np.zeros(0, bool)
            out = [own.tokens[met].view(np.int64), own.ids[own.set[met]], own.sizes[own.set[met]].astype(np.int64), own.place[met]]
        return pa.table([*map(pa.array, out)], names=["token", "id", "n", "place"])

    packed = units.select("unit", "id", "n", "tokens")
    replies = packed.mapInArrow(send, "part long, unit long, tokens binary, several binary").groupBy("part").applyInArrow(settle, "unit long, part long, shared binary")
    return packed.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(pick, "token long, id long, n long, place long")


def _kept_pairs(test: Callable[[dict], bool]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.select(["a", "b"]).filter(pa.array([test(r) for r in batch.to_pylist()], pa.bool_()))

    return work


def _alike(pairs: DataFrame, sets: DataFrame, keyed: DataFrame, similarity: float) -> DataFrame:
    """Of ``pairs`` (a, b: set ids) those that are similar, by their whole shingle sets.

    The parity bitmaps first rule out pairs that differ in too many shingles; they never rule out a similar pair.
    """

    def may_be(r: dict) -> bool:
        return places_apart(r["bits_a"], r["bits_b"]) <= (r["n_a"] + r["n_b"]) * (1 - similarity) / (1 + similarity) + 1e-6

    def are(r: dict) -> bool:
        x, y = np.frombuffer(r["in_a"], np.uint64), np.frombuffer(r["in_b"], np.uint64)
        shared = len(np.intersect1d(x, y, assume_unique=True))
        return shared >= similarity * (len(x) + len(y) - shared) - 1e-9

    side = lambda name: sets.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("bits").alias(f"bits_{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    left = keep_plan_short(map_slices(met, _kept_pairs(may_be), "a long, b long"))
    wanted = left.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(sets.select("id", "first"), "id").select("id", F.col("first.doc_id").alias("of_doc"), F.col("first.text_hash").alias("of_text"))
    wanted = keep_plan_short(wanted)
    few = wanted.count() <= VERIFIED_TEXTS
    texts = keyed.join(F.broadcast(wanted) if few else wanted, (F.col("text_hash") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("id", "text")
    whole = map_slices(texts, _whole_sets, "id long, shingles binary")
    both = left.join(whole.select(F.col("id").alias("a"), F.col("shingles").alias("in_a")), "a").join(whole.select(F.col("id").alias("b"), F.col("shingles").alias("in_b")), "b")
    return map_slices(both, _kept_pairs(are), "a long, b long")


def _enough_left(similarity: float) -> Column:
    """Whether two sets that have no earlier shingle in common can still share enough, from their places in both."""
    needed = (F.col("n_a") + F.col("n_b")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)
    return F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed


def _near(n_a: Column, n_b: Column, similarity: float) -> Column:
    return F.least(n_a, n_b) >= F.lit(similarity) * F.greatest(n_a, n_b) - F.lit(1e-9)


def _printed_pairs(sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of sets that their fingerprints propose: all with the first set of the same fingerprint, and the
    first sets of fingerprints that BK-trees link (``near_links``). At most one pair a set and one a link."""
    classes = keep_plan_short(sets.groupBy("print").agg(F.min("id").alias("of_print")))
    same = sets.select("id", "print").join(classes, "print").select(F.col("id").alias("a"), F.col("of_print").alias("b"))
    links = near_links(classes.select(F.col("print").alias("id"), F.array("print").alias("fingerprint")), exact_masks(RADIUS), RADIUS)
    end = lambda c: classes.select(F.col("print").alias(c), F.col("of_print").alias(f"set_{c}"))
    near = links.join(end("a"), "a").join(end("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return same.unionByName(near).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _apart(pairs: DataFrame, rooted: DataFrame) -> DataFrame:
    """Pairs whose sets are not in one component yet."""
    root = lambda c: rooted.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def set_components(units: DataFrame, keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the sets connected by pairs of the similarity or more; no such pair is missed.

    First the sets whose SimHash fingerprints are linked through BK-trees are verified on their shingles. At similarity 0.8
    fingerprints may differ in more bits than any tree can exclude, so an exact search follows for what is not connected yet.
    Two similar sets have a shingle in common within their prefixes, so they meet in its bucket, and in the bucket of the
    first one they share, enough is left of both. There each set is compared with one pivot only: in every bucket the set
    whose shingles are the most shared, the likely origin of a group of copies, stands for its size class, and of these a
    set takes the one it meets most often. Then all members of a bucket that are not yet in one component are compared.
    """
    printed = keep_plan_short(_printed_pairs(sets))
    near = keep_plan_short(_alike(printed, sets, keyed, similarity))
    met = _shared_shingles(units, similarity).distinct()
    met = keep_plan_short(met)
    members = met.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    shared = met.join(members, "token")
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    central = shared.groupBy("id").agg(F.round(F.sum(F.log2("members")) / F.first(prefix), 3).alias("score"))
    met = keep_plan_short(shared.drop("members").join(central, "id"))
    pair = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    classed = met.withColumn("class", F.floor(F.log("n") / F.log(F.lit(1 / similarity))))  # sets of one class are near in size
    pivots = classed.groupBy("token", "class").agg(F.max(F.struct("score", "id", "n")).alias("pivot"))
    chance = classed.join(pivots, ["token", "class"]).where((F.col("id") != F.col("pivot.id")) & _near(F.col("n"), F.col("pivot.n"), similarity))
    often = chance.groupBy("id", "pivot.id", "pivot.score").agg(F.count("*").alias("times")).toDF("id", "other", "score", "times")
    chosen = often.groupBy("id").agg(F.max(F.struct("times", "score", "other")).alias("best")).select(F.col("id").alias("a"), F.col("best.other").alias("b"))
    tried = keep_plan_short(_apart(chosen.select(*pair).distinct().join(printed, ["a", "b"], "left_anti"), components(near)))
    links = keep_plan_short(near.unionByName(_alike(tried, sets, keyed, similarity)))
    rooted = components(links)

    known = met.join(rooted.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = known.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("least"), F.max("root").alias("most"))
    open_ones = sizes.where(F.col("least") != F.col("most")).select("token", F.ceil(F.col("members") / F.lit(SHARD_MEMBERS)).alias("parts"))
    mixed_ones = keep_plan_short(known.join(open_ones, "token"))
    of = lambda name: [F.col(c).alias(f"{c}_{name}") for c in ("n", "place")]
    left = mixed_ones.select("token", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.col("id").alias("a"), F.col("root").alias("root_a"), *of("a"))
    right = mixed_ones.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("root").alias("root_b"), *of("b"))
    rest = left.join(right, ["token", "part"]).where((F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & _enough_left(similarity))
    rest = keep_plan_short(rest.select("a", "b").distinct().join(tried.unionByName(printed), ["a", "b"], "left_anti"))
    return components(links.unionByName(_alike(rest, sets, keyed, similarity)))


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, n_rows, keep: per distinct (doc_id, text), whether it is the one of its group that stays.

    The document with the smallest id of a group stays (null ids last; of several with that id, the one with the
    smallest text hash). Groups are the components of the pairs whose sets of five-word shingles have the Jaccard
    similarity or more. Texts without words (null and empty ones too) have the same empty set and form one group; a text
    of fewer than five words is one shingle. Very long texts are hashed whole, one at a time. An empty table gives an
    empty result; other columns are not read.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    units = keep_plan_short(_units(keyed, similarity))
    rows = units.mapInArrow(_rows_of_units, ROW_SCHEMA)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first")
    sets = keep_plan_short(rows.groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("print").alias("print"), least))
    rooted = set_components(units, keyed, sets, similarity)
    # Aggregated before its shuffle: a group of a third of all sets is one row a task. Its winner is then looked up by document.
    winners = sets.select("id", "first").join(rooted.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first"))
    winners = winners.select(F.col("first.doc_id").alias("of_doc"), F.col("first.text_hash").alias("of_text"))
    texts = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_rows"))
    same = (F.col("text_hash") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))
    return texts.join(winners, same, "left").select("doc_id", "text_hash", "n_rows", F.col("of_text").isNotNull().alias("keep"))


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies (see ``near_duplicates``).

    All columns stay, whatever their names. Repeated rows count as copies; an empty table stays empty.
    """
    judged = keep_plan_short(near_duplicates(docs, similarity).where(~F.col("keep") | (F.col("n_rows") > 1)))
    sized = F.broadcast if judged.count() <= DROPPED_ROWS else (lambda df: df)
    name = free_name(docs, "text_hash")
    keyed = docs.withColumn(name, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = lambda other: keyed["doc_id"].eqNullSafe(other["doc_id"]) & (keyed[name] == other["text_hash"])
    single = keyed.join(sized(judged), same(judged), "left_anti")
    repeated = judged.where("keep")
    once = keyed.join(sized(repeated), same(repeated), "left_semi").dropDuplicates(["doc_id", name])
    return single.unionByName(once).drop(name)
