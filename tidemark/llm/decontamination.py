"""Benchmark decontamination: short test items found inside long documents by MinHash containment, verified exactly.

Words are maximal runs of ASCII letters, digits and non-ASCII characters of the lower-cased text; shingles are five
words (a shorter item is one shingle of all its words and is sought as such). An item is contained in a document if the
document has ``threshold`` (0.8) or more of the item's distinct shingles.

Items are partitioned by size. A MinHash sketch of an item is its smallest shingle hashes; how many are kept depends on
the size partition: n - ceil(threshold * n) + 1 of n, rounded up over the partition's sizes. A document that contains
0.8 of the item then holds at least one sketch hash for certain, however long the document is, so the search loses
nothing. Documents are not sketched: every shingle of every document probes the sketches. Items met are verified in the
same task against the document's real shingles, as strings and not as hashes.

Scale: documents are scanned where they are, without a shuffle. The sketches are broadcast in blocks of about
``block_items`` items and ``block_bytes`` of text, whichever is reached first; a larger benchmark makes more passes over
the documents, one a block. A benchmark is a given list, and the driver holds one block of it at a time.

Null and empty texts have no words and contain nothing; items without words are sought nowhere; repeated items and
repeated rows give repeated results; a very long text is hashed whole, in memory that grows with it; empty tables give an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_windows import groups_up_to, joined, mixed, prefix_sums, span_hash
from tidemark.llm.frames import map_slices, of_texts, texts_of, with_small_batches

SHINGLE = 5
THRESHOLD = 0.8
CHUNK_BYTES = 1 << 18
#: Size partitions of items, by number of distinct shingles: powers of two.
SCHEMA = "doc_id long, item_id long, n_shared long, n_item long, containment double"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in lower-cased bytes."""
    inside = np.concatenate([[False], _WORD[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2]


def words_of(data: bytes) -> list[bytes]:
    start, end = word_spans(np.frombuffer(data, np.uint8))
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def shingles_of(words: list[bytes], n: int = SHINGLE) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def rolling_shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbours among word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x100000001B3) + words[i : i + len(out)]
    return mixed(out, salt=n)


def sketch_size(n: int, threshold: float) -> int:
    """Smallest hashes kept of an item of n shingles, the same over its size partition (sizes 2**k to 2**(k+1) - 1)."""
    most = (1 << n.bit_length()) - 1
    return min(n, most - int(np.ceil(threshold * most - 1e-9)) + 1)


@dataclass(frozen=True)
class Sketches:
    """hashes (sorted) and the item each belongs to; items: id, width of its shingles, the shingles."""

    hashes: np.ndarray
    owner: np.ndarray
    widths: tuple[int, ...]
    items: list[tuple[int, int, frozenset[bytes]]]


def build_sketches(items: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> Sketches:
    hashes, owner, kept = [], [], []
    for item_id, text in items:
        words = words_of(normal(text))
        if not words:
            continue
        width = min(SHINGLE, len(words))
        data = b" ".join(words)
        raw = np.frombuffer(data, np.uint8)
        own = np.unique(rolling_shingles(span_hash(prefix_sums(raw), *word_spans(raw)), width))
        own = own[: sketch_size(len(own), threshold)]
        hashes.append(own)
        owner.append(np.full(len(own), len(kept)))
        kept.append((item_id, width, frozenset(shingles_of(words, width))))
    if not kept:
        return Sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), (), [])
    h, o = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(h, kind="stable")
    return Sketches(h[order], o[order], tuple(sorted({w for _, w, _ in kept})), kept)


def candidates(sketches: Sketches, texts: list[bytes]) -> list[tuple[int, int]]:
    """(text, item) pairs that share a sketch hash."""
    found: set[tuple[int, int]] = set()
    if not len(sketches.hashes):
        return []
    # A table of the hashes' top bits answers most probes with one look.
    bits = np.zeros(1 << 20, bool)
    bits[(sketches.hashes >> np.uint64(44)).astype(np.int64)] = True
    for a, b in groups_up_to([len(t) for t in texts], CHUNK_BYTES):
        data, starts = joined(texts[a:b], gap=1)
        start, end = word_spans(data)
        hashes = span_hash(prefix_sums(data), start, end)
        text = np.searchsorted(starts, start, side="right") - 1
        for width in sketches.widths:
            if len(start) < width:
                continue
            own = rolling_shingles(hashes, width)
            at = np.flatnonzero(bits[(own >> np.uint64(44)).astype(np.int64)] & (text[: len(own)] == text[width - 1 :]))
            low = np.searchsorted(sketches.hashes, own[at], side="left")
            high = np.searchsorted(sketches.hashes, own[at], side="right")
            for i in np.flatnonzero(high > low).tolist():
                found |= {(a + int(text[at[i]]), int(o)) for o in sketches.owner[low[i] : high[i]]}
    return sorted(found)


def contained(sketches: Sketches, texts: list[str], threshold: float) -> list[tuple[int, int, int, int]]:
    """(text, item id, shared shingles, item's shingles) of the pairs that hold, verified on the shingles themselves."""
    raw = [normal(t) for t in texts]
    out, have = [], {}
    for text, item in candidates(sketches, raw):
        item_id, width, wanted = sketches.items[item]
        if have.get("of") != text:
            have = {"of": text, "words": words_of(raw[text])}
        if width not in have:
            have[width] = {b" ".join(have["words"][i : i + width]) for i in range(len(have["words"]) - width + 1)}
        shared = len(wanted & have[width])
        if shared >= threshold * len(wanted) - 1e-9:
            out.append((text, item_id, shared, len(wanted)))
    return out


def _blocks(benchmark: DataFrame, threshold: float, block_items: int, block_bytes: int) -> Iterator[Sketches]:
    """The benchmark's sketches, a block at a time."""
    size = benchmark.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-size["bytes"] // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    for i in range(n_blocks):
        rows = benchmark.select("item_id", "text").where(block == i).collect()
        yield build_sketches([(r["item_id"], r["text"]) for r in rows], threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_items: int = 50_000, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` (doc_id, text) and ``benchmark`` (item_id, text) to the pairs where the document contains the item."""
    context, out = docs.sparkSession.sparkContext, None
    for sketches in _blocks(benchmark, threshold, block_items, block_bytes):
        shared = context.broadcast(sketches)

        def work(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows = contained(shared.value, texts_of(batch), threshold)
            ids = batch.column("doc_id").cast(pa.int64()).to_pylist()
            text, item, n_shared, n_item = map(list, zip(*rows, strict=True)) if rows else ([], [], [], [])
            share = [a / b for a, b in zip(n_shared, n_item, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in text], pa.int64()), *(pa.array(x, pa.int64()) for x in (item, n_shared, n_item)), pa.array(share, pa.float64())], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        part = map_slices(docs.select("doc_id", "text"), work, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_items: int = 50_000, block_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay."""
    context, out = docs.sparkSession.sparkContext, docs
    with_small_batches(docs.sparkSession)
    for sketches in _blocks(benchmark, threshold, block_items, block_bytes):
        shared = context.broadcast(sketches)

        def clean(texts: list[str | None], shared=shared) -> list[bool]:
            leaked = {x[0] for x in contained(shared.value, [t or "" for t in texts], threshold)}
            return [i not in leaked for i in range(len(texts))]

        out = out.where(of_texts(F.col("text"), clean, "boolean"))
    return out
