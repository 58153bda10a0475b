"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

A full suffix array has an entry for each byte of the corpus; its entries, moved once, are some fifty times the corpus.
This operator sorts a sparse one that loses nothing. Positions are *anchors*: an anchor is the place of the smallest
hash among the K-byte strings of some 50-byte window (about two in W + 1 positions). Equal windows have equal anchors
at equal places, so windows can only match where anchors do.

1. Texts are packed into compressed chunks and written once to the shared checkpoint folder. Chunks in a row, up to
   ``unit_bytes`` of text, are a unit (a longer document is alone in one).
2. Splitters of the anchors' suffixes by leading bytes are taken from a sample of the chunks. Every unit sorts its
   suffixes and sends their distinct keys (``HEAD_BYTES`` leading bytes, 24 bits of the hash of the K-byte string) to the
   buckets between the splitters; equal keys never straddle a border, so that no comparison across borders is left. A bucket
   sorts its keys; only those of several units or documents (*shared* ones) go on. A key is a filter: it decides nothing else.
3. Shared anchors are sorted by key, *digest* of the whole context (all bytes of all 50-byte windows around the anchor) and
   document. An anchor whose context a smaller document has is *covered* with all its windows. One whose key other documents
   have in other contexts is *open*.
4. The windows of open anchors (a few per cent) are sorted the same way by key and digest, which settles them one by one: a
   window is removed if a smaller document has it.
5. Each unit marks what is covered and returns its documents.

What decides: within a unit, bytes are compared with bytes, and hashes only bring equal ones together. Between units, the key
and a digest (a seeded hash that multiplies and rotates words of the bytes themselves, unrelated to the rolling hash of the
key; 96 bits of contexts, and of windows 72 bits beside 24 of the key) must be equal. So 96 bits tell two strings apart: a phrase that has a thousand million
contexts makes a false match with a probability of 1e-11, and all pairs of 100 TB with less than 1e-9.

Skew: a unit sends equal suffixes once, with its smallest document, so a passage in a third of all documents is one
entry a unit and not one a document. If one anchor has more than ``many`` contexts in a unit, one entry stands for all
and they count as open. A row is what one unit sends to one bucket: units and buckets have a size of their own, and
there are no more buckets than it takes for ``BUCKET_BYTES`` of text each or for all tasks to have one. A bucket is
sorted in slices of ``slice`` suffixes, so its memory is what it has received, packed. Nothing but the splitters' sample
(``SAMPLE`` numbers at most) comes to the driver.

Null texts are empty; a null doc_id counts as larger than any id; rows with one doc_id are not smaller than each other,
so repeated rows keep their bytes; empty texts have the hash of the empty string; an empty table gives an empty result;
other columns are not read. A very long text is handled in pieces of ``PIECE`` bytes, its suffixes as one unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.byte_windows import gram_hash, mixed, prefix_sums, sliding_min, span_hash
from tidemark.llm.frames import keep_plan_short, texts_of, with_small_batches

NEED = 50
K = 25
W = NEED - K + 1
SIDE = NEED - K
#: Text whose suffixes one bucket is meant for.
BUCKET_BYTES = 128 << 20
#: Bytes of a chunk that are hashed at a time, and strings that are compared or digested at a time.
PIECE, GATHER = 1 << 18, 1 << 16
#: Leading bytes that travel as they are, in front of 24 bits of a hash; bytes of the digests of contexts and of windows
#: (whose key has 24 more bits that tell them apart).
HEAD_BYTES, CONTEXT_DIGEST, WINDOW_DIGEST = 5, 12, 9


class Settings(NamedTuple):
    """Sizes that decide how work is cut, never what comes out."""

    chunk_bytes: int = 1 << 19
    unit_bytes: int = 32 << 20
    many: int = 32
    #: Suffixes that a bucket sorts at a time.
    slice: int = 1 << 20
    #: Bytes of the hash that brings equal strings together inside a unit.
    near_bytes: int = 8


#: One chunk in so many is looked at for splitters (all, if there are no more than that); suffixes sampled at most.
SAMPLED_CHUNKS, SAMPLE = 16, 1_000_000
#: Compression level of the texts, which are written and shuffled once.
BODY_LEVEL = 5
#: Between documents; no byte of UTF-8.
GAP = b"\xff" * 64
NO_ID = np.iinfo(np.int64).max

CHUNK_SCHEMA = "unit long, chunk int, n_bytes long, ids binary, sizes binary, body binary"
SENT_SCHEMA = "bucket long, unit long, packed binary"
REPLY_SCHEMA = "unit long, round int, bucket long, packed binary"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _squeeze(x: np.ndarray | bytes) -> bytes:
    return zstandard.compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes(), 1)


def _spread(blob: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _bundle(parts: list[np.ndarray]) -> bytes:
    """Arrays one after another behind their lengths, compressed as one."""
    raw = [np.ascontiguousarray(x).tobytes() for x in parts]
    return _squeeze(b"".join([np.array([len(raw), *map(len, raw)], np.uint32).tobytes(), *raw]))


def _unbundle(blob: bytes) -> list[bytes]:
    data = zstandard.decompress(blob)
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64)
    return [data[a:b] for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist(), strict=True)]


def _planes(x: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of every number, most significant plane first: sorted numbers have long runs there."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :n][:, ::-1].T)


def _from_planes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(blob) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(n, -1)[::-1].T
    return out.view(np.uint64).ravel()


def _pack(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    texts: list[bytes] = []
    held = in_unit = made = 0
    unit = TaskContext.get().partitionId() << 32

    def chunk() -> pa.RecordBatch:
        nonlocal ids, texts, held, made, unit, in_unit
        if in_unit and in_unit + held > settings.unit_bytes:
            unit, in_unit = unit + 1, 0
        row = [unit], [made], [held], [_squeeze(np.array(ids, np.int64))], [_squeeze(np.array([len(t) for t in texts], np.int64))], [zstandard.compress(b"".join(texts), BODY_LEVEL)]
        in_unit += held
        ids, texts, held, made = [], [], 0, made + 1
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                if texts and held + len(raw) > settings.chunk_bytes:
                    yield chunk()
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(raw)
                held += len(raw)
    if texts:
        yield chunk()


class Chunk:
    """A chunk's documents laid out with gaps between them."""

    def __init__(self, ids: bytes, sizes: bytes, body: bytes) -> None:
        self.ids, self.sizes = _spread(ids), _spread(sizes)
        raw = zstandard.decompress(body)
        ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(GAP + b"".join(raw[e - n : e] + GAP for e, n in zip(ends.tolist(), self.sizes.tolist(), strict=True)), np.uint8)
        self.start = np.cumsum(self.sizes + len(GAP)) - self.sizes
        self.end = self.start + self.sizes

    def pieces(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(low, high, offset, sums): places low..high are this piece's, ``sums`` start at ``offset``."""
        margin = 3 * NEED
        for low in range(0, len(self.data), PIECE):
            high = min(len(self.data), low + PIECE)
            offset = max(0, low - margin)
            yield low, high, offset, prefix_sums(self.data[offset : high + margin])

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(self.start, at, side="right") - 1, 0)

    def keys(self, at: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The first bytes at a place, then bits of a fingerprint: numbers in the order of the leading bytes."""
        head = np.zeros(len(at), np.uint64)
        for i in range(HEAD_BYTES):
            head = head << np.uint64(8) | self.data[at + i]
        return head << np.uint64(64 - 8 * HEAD_BYTES) | mixed(prints, salt=7) >> np.uint64(8 * HEAD_BYTES)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """place, document, fingerprint of the leading K bytes, fingerprint of the context."""
        out: list[list[np.ndarray]] = [[], [], []]
        for low, high, offset, sums in self.pieces():
            lead = gram_hash(sums, K)
            edge = np.zeros(W - 1, np.uint64)
            if len(lead) < W:
                continue
            least = np.concatenate([edge, sliding_min(lead, W), edge])
            at = np.flatnonzero(~sliding_min(~least, W) == lead)
            at = at[(at + offset >= low) & (at + offset < high)]
            doc = self.doc_of(at + offset)
            at = at[(at + offset >= self.start[doc]) & (at + offset + K <= self.end[doc]) & (self.sizes[doc] >= NEED)]
            for column, value in zip(out, (at + offset, lead[at], span_hash(sums, at - SIDE, at + K + SIDE)), strict=True):
                column.append(value)
        place, lead, context = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in out)
        place = place.astype(np.int64)
        return place, self.doc_of(place), lead, context

    def windows(self, open_at: np.ndarray, open_lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """place, document and fingerprint of every 50-byte window whose smallest K-byte string is an open anchor."""
        places, prints = [], []
        for low, high, offset, sums in self.pieces():
            mine = (open_at >= low - SIDE) & (open_at < high + SIDE)
            if not mine.any():
                continue
            lead = gram_hash(sums, K)
            least = sliding_min(lead, W)
            at = open_at[mine][:, None] - np.arange(W)[None, :]
            good = (at >= low) & (at < high) & (at - offset < len(least))
            own = np.broadcast_to(open_lead[mine][:, None], at.shape)[good]
            at = at[good]
            at = np.unique(at[least[at - offset] == own])
            doc = self.doc_of(at)
            at = at[(at >= self.start[doc]) & (at + NEED <= self.end[doc])]
            places.append(at)
            prints.append(span_hash(sums, at - offset, at - offset + NEED))
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        return place, self.doc_of(place), np.concatenate(prints) if prints else np.zeros(0, np.uint64)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """For keys in order: whether each entry starts a run of equal ones."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def digest(rows: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers of every row of bytes: its 8-byte words, multiplied, rotated and mixed one after another."""
    n, width = rows.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = rows
    words = words.view(np.uint64)
    out = np.empty((2, n), np.uint64)
    for lane, (seed, by, turn) in enumerate(((0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 29), (0x165667B19E3779F9, 0xD6E8FEB86659FD93, 37))):
        h = np.full(n, seed ^ width, np.uint64)
        for k in range(words.shape[1]):
            x = mixed(words[:, k] ^ np.uint64(seed), salt=lane + 1)
            h = (h ^ x) * np.uint64(by)
            h = (h << np.uint64(turn) | h >> np.uint64(64 - turn)) + x
        out[lane] = mixed(h)
    return out


class Strings:
    """Places of strings of one length in a unit's bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: int, digest_bytes: int) -> None:
        self.data, self.start, self.length, self.digest_bytes = data, start, length, digest_bytes

    def rows(self, pick: np.ndarray) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.data, self.length)[self.start[pick]]

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the strings a and b are the same bytes."""
        parts = [(self.rows(a[k : k + GATHER]) == self.rows(b[k : k + GATHER])).all(1) for k in range(0, len(a), GATHER)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    def digests(self, pick: np.ndarray) -> np.ndarray:
        parts = [digest(self.rows(pick[k : k + GATHER])) for k in range(0, len(pick), GATHER)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.uint64)


def _by_bucket(key: np.ndarray, sent: np.ndarray, splitters: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per bucket, the entries sent to it, in order of their keys."""
    bucket = np.searchsorted(splitters, key[sent], side="right")
    cuts = np.flatnonzero(_first_of(bucket)) if len(sent) else sent
    return [(int(bucket[a]), sent[a:b]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)], strict=False)]


def _row(bucket: int, unit: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([unit], pa.int64()), pa.array([_bundle(parts)], pa.binary())], ["bucket", "unit", "packed"])


class Keys:
    """What a unit sends first: its distinct keys; ``of`` maps its suffixes to them."""

    def __init__(self, ids: np.ndarray, key: np.ndarray, splitters: np.ndarray) -> None:
        order = np.lexsort((ids, key))
        new = _first_of(key[order]) if len(order) else np.zeros(0, bool)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.key = key[order][at]
        in_order = ids[order]
        #: Whether several of the unit's own documents have the key.
        self.several = in_order[at] != in_order[np.append(at[1:], len(order)) - 1] if len(order) else np.zeros(0, bool)
        self.parts = _by_bucket(self.key, np.arange(len(at)), splitters)

    def rows(self, unit: int) -> Iterator[pa.RecordBatch]:
        for bucket, pick in self.parts:
            yield _row(bucket, unit, [_planes(self.key[pick], 8)])

    def shared(self, replies: dict[int, bytes]) -> np.ndarray:
        """By suffix, whether its key is met in several units or documents."""
        out = self.several.copy()
        for bucket, pick in self.parts:
            out[pick] |= np.unpackbits(np.frombuffer(_unbundle(replies[bucket])[0], np.uint8), count=len(pick)).astype(bool)
        return out[self.of]


class Entries:
    """What a unit sends of strings: distinct (key, string) with the smallest document; ``of`` maps its strings to them.

    ``near`` is a hash of each string that brings equal ones together; their bytes decide. If it brings others between
    them, a string has several entries, and the bucket finds them equal.
    """

    def __init__(self, ids: np.ndarray, key: np.ndarray, near: np.ndarray, strings: Strings, splitters: np.ndarray, many: int) -> None:
        order = np.lexsort((ids, near, key))
        new = _first_of(key[order], near[order]) if len(order) else np.zeros(0, bool)
        like = np.flatnonzero(~new)
        new[like] = ~strings.same(order[like - 1], order[like])
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        pick = order[new]
        self.key, self.ids, self.pick, self.strings = key[pick], ids[pick], pick, strings
        run = _first_of(self.key) if len(pick) else np.zeros(0, bool)
        group = np.cumsum(run) - 1
        size = np.bincount(group) if len(pick) else np.zeros(0, np.int64)
        self.many = (size > many)[group] if len(pick) else np.zeros(0, bool)
        self.parts = _by_bucket(self.key, np.flatnonzero(~self.many | run), splitters)

    def rows(self, unit: int) -> Iterator[pa.RecordBatch]:
        for bucket, pick in self.parts:
            docs, index = np.unique(self.ids[pick], return_inverse=True)
            both = self.strings.digests(self.pick[pick])
            yield _row(bucket, unit, [docs, index.astype(np.uint16 if len(docs) < 65536 else np.uint32), _planes(self.key[pick], 8), _planes(both[0], 8), _planes(both[1], self.strings.digest_bytes - 8), np.packbits(self.many[pick])])

    def answers(self, replies: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By entry, whether it is covered and whether it is open."""
        covered, opened = np.zeros(len(self.key), bool), self.many.copy()
        for bucket, pick in self.parts:
            a, b = (np.unpackbits(np.frombuffer(x, np.uint8), count=len(pick)).astype(bool) for x in _unbundle(replies[bucket]))
            covered[pick] = a
            opened[pick] |= b
        return covered & ~self.many, opened  # one entry stood for many


class _Sent:
    """One row of a bucket, unpacked as far as it must be."""

    def __init__(self, packed: bytes) -> None:
        docs, index, key, *self.digest, many = _unbundle(packed)
        docs = np.frombuffer(docs, np.int64)
        self.key = _from_planes(key, 8)
        self.docs, self.index = docs, np.frombuffer(index, np.uint16 if len(docs) < 65536 else np.uint32)
        self.many = np.unpackbits(np.frombuffer(many, np.uint8), count=len(self.key)).astype(bool)

    def half(self, k: int, a: int, b: int) -> np.ndarray:
        n = len(self.digest[k]) // len(self.key)
        return _from_planes(np.frombuffer(self.digest[k], np.uint8).reshape(n, -1)[:, a:b].tobytes(), n)


def _sorted_out(key: np.ndarray, high: np.ndarray, low: np.ndarray, doc: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by several keys; which are covered and which are open."""
    order = np.lexsort((doc, low, high, key))
    key, doc_in = key[order], doc[order]
    same_key, same = _first_of(key), _first_of(key, high[order], low[order])
    by_key, by_string = np.cumsum(same_key) - 1, np.cumsum(same) - 1
    covered = doc_in > doc_in[same][by_string]
    at = np.flatnonzero(same_key)
    apart = np.minimum.reduceat(doc_in, at) != np.maximum.reduceat(doc_in, at)
    several = np.add.reduceat(same.astype(np.int64), at) > 1
    crowded = np.logical_or.reduceat(many[order], at)
    opened = ((apart & several) | crowded)[by_key] & ~covered
    first, second = np.empty(len(order), bool), np.empty(len(order), bool)
    first[order], second[order] = covered, opened
    return first, second


def _slices(keys: list[np.ndarray], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sorted lists of keys in slices of about ``most`` of all, equal keys together: (list, from, to)."""
    n = -(-sum(map(len, keys)) // most)
    borders = np.zeros(0, np.uint64)
    if n > 1:
        some = np.sort(np.concatenate([k[::64] for k in keys]))
        borders = np.unique(some[np.arange(1, n) * len(some) // n])
    cuts = [np.concatenate([[0], np.searchsorted(k, borders), [len(k)]]).tolist() for k in keys]
    for j in range(len(borders) + 1):
        spans = [(i, c[j], c[j + 1]) for i, c in enumerate(cuts) if c[j + 1] > c[j]]
        if spans:
            yield spans


def _replied(table: pa.Table, round_no: int, bits: list[list[np.ndarray]]) -> pa.Table:
    packed = [_bundle([np.packbits(x) for x in each]) for each in bits]
    return pa.table([table.column("unit"), pa.array([round_no] * len(packed), pa.int32()), table.column("bucket"), pa.array(packed, pa.binary())], names=["unit", "round", "bucket", "packed"])


def _find_shared(settings: Settings):
    """Sort one bucket's keys, slice by slice; reply to each unit which of its keys another unit has."""

    def work(table: pa.Table) -> pa.Table:
        keys = [_from_planes(_unbundle(x.as_py())[0], 8) for x in table.column("packed")]
        out = [np.zeros(len(k), bool) for k in keys]
        for spans in _slices(keys, settings.slice):
            every = np.sort(np.concatenate([keys[i][a:b] for i, a, b in spans]))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            for i, a, b in spans:
                at = np.minimum(np.searchsorted(twice, keys[i][a:b]), max(0, len(twice) - 1))
                out[i][a:b] = twice[at] == keys[i][a:b] if len(twice) else False
        return _replied(table, 1, [[x] for x in out])

    return work


def _settle(round_no: int, settings: Settings):
    """Sort one bucket's strings, slice by slice; reply to each unit which of its entries are covered and which open."""

    def work(table: pa.Table) -> pa.Table:
        rows = [_Sent(x.as_py()) for x in table.column("packed")]
        first, second = [np.zeros(len(r.key), bool) for r in rows], [np.zeros(len(r.key), bool) for r in rows]
        for spans in _slices([r.key for r in rows], settings.slice):
            part = lambda of, spans=spans: np.concatenate([of(rows[i], a, b) for i, a, b in spans])
            covered, opened = _sorted_out(part(lambda r, a, b: r.key[a:b]), part(lambda r, a, b: r.half(0, a, b)), part(lambda r, a, b: r.half(1, a, b)), part(lambda r, a, b: r.docs[r.index[a:b]]), part(lambda r, a, b: r.many[a:b]))
            at = 0
            for i, a, b in spans:
                first[i][a:b], second[i][a:b] = covered[at : at + b - a], opened[at : at + b - a]
                at += b - a
        return _replied(table, round_no, [list(x) for x in zip(first, second, strict=True)])

    return work


class Unit:
    """A unit's chunks, one after another in ``data``, and the suffixes of its anchors."""

    def __init__(self, rows: list[dict], settings: Settings) -> None:
        self.settings = settings
        self.chunks = [Chunk(r["ids"], r["sizes"], r["body"]) for r in rows]
        self.data = np.concatenate([c.data for c in self.chunks]) if len(self.chunks) > 1 else self.chunks[0].data
        #: Where each chunk starts in ``data``.
        self.shift = np.cumsum([0] + [len(c.data) for c in self.chunks])[:-1].tolist()
        for chunk, at in zip(self.chunks, self.shift, strict=True):
            chunk.data = self.data[at : at + len(chunk.data)]
        found = [c.anchors() for c in self.chunks]
        self.cuts = np.cumsum([len(x[0]) for x in found])[:-1]
        self.place, self.doc, self.lead = ([x[i] for x in found] for i in range(3))
        self.ids = np.concatenate([c.ids[x[1]] if len(x[1]) else np.zeros(0, np.int64) for c, x in zip(self.chunks, found, strict=True)])
        self.key = np.concatenate([c.keys(x[0], x[2]) for c, x in zip(self.chunks, found, strict=True)])
        self.near = self.shortened(np.concatenate([x[3] for x in found]))
        self.start = np.concatenate([x[0] + at - SIDE for x, at in zip(found, self.shift, strict=True)])

    def shortened(self, prints: np.ndarray) -> np.ndarray:
        return prints >> np.uint64(64 - 8 * self.settings.near_bytes)

    def keys(self, splitters: np.ndarray) -> Keys:
        return Keys(self.ids, self.key, splitters)

    def contexts(self, splitters: np.ndarray, replies: dict[int, bytes]) -> tuple[np.ndarray, Entries]:
        """The anchors whose keys are shared, and the entries of their contexts."""
        shared = np.flatnonzero(self.keys(splitters).shared(replies))
        strings = Strings(self.data, self.start[shared], K + 2 * SIDE, CONTEXT_DIGEST)
        return shared, Entries(self.ids[shared], self.key[shared], self.near[shared], strings, splitters, self.settings.many)

    def judged(self, splitters: np.ndarray, shared_replies: dict[int, bytes], replies: dict[int, bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per chunk, which of its anchors are covered and which are open."""
        shared, entries = self.contexts(splitters, shared_replies)
        first, second = entries.answers(replies)
        covered, opened = np.zeros(len(self.ids), bool), np.zeros(len(self.ids), bool)
        covered[shared] = first[entries.of] | (self.ids[shared] > entries.ids[entries.of])
        opened[shared] = second[entries.of]
        return np.split(covered, self.cuts), np.split(opened & ~covered, self.cuts)

    def windows(self, opened: list[np.ndarray], splitters: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, Entries]:
        """Per chunk the places of the windows of open anchors, then the documents of all of them and their entries."""
        places, starts, ids, keys, near = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for chunk, shift, place, lead, is_open in zip(self.chunks, self.shift, self.place, self.lead, opened, strict=True):
            at, doc, prints = chunk.windows(place[is_open], lead[is_open])
            places.append(at)
            if len(at):
                starts.append(at + shift)
                ids.append(chunk.ids[doc])
                keys.append(chunk.keys(at, prints))
                near.append(self.shortened(prints))
        every = np.concatenate(ids)
        strings = Strings(self.data, np.concatenate(starts), NEED, WINDOW_DIGEST)
        return places, every, Entries(every, np.concatenate(keys), np.concatenate(near), strings, splitters, self.settings.many)


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The chunks of one unit after another, as they were written one after another."""
    rows: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            if rows and rows[0]["unit"] != row["unit"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _replies(table: pa.Table, round_no: int) -> dict[int, bytes]:
    return {r["bucket"]: r["packed"] for r in table.to_pylist() if r["round"] == round_no}


def _sample_splitters(chunks: DataFrame, n_chunks: int, buckets: int, settings: Settings) -> np.ndarray:
    """Keys that cut the suffixes of a sample of the chunks into ``buckets`` even parts. They only decide the balance."""
    share = 1 if n_chunks <= SAMPLED_CHUNKS else SAMPLED_CHUNKS
    seen = max(1, n_chunks // share) * settings.chunk_bytes // 13  # suffixes met, about
    step = max(1, -(-seen // min(SAMPLE, 200 * buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key = Unit(batch.slice(k, 1).to_pylist(), settings).key[::step]
                yield pa.RecordBatch.from_arrays([pa.array([key.tobytes()], pa.binary())], ["keys"])

    some = chunks.where(F.pmod(F.xxhash64("unit", "chunk"), F.lit(share)) == 0).select("ids", "sizes", "body")
    blobs = [bytes(r["keys"]) for r in some.mapInArrow(run, "keys binary").collect()]  # SAMPLE numbers of 8 bytes, about
    keys = np.sort(np.frombuffer(b"".join(blobs), np.uint64))
    return np.unique(keys[np.arange(1, buckets) * len(keys) // buckets]) if len(keys) else np.zeros(0, np.uint64)


def suffix_dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    with_small_batches(docs.sparkSession)
    chunks = keep_plan_short(docs.select("doc_id", "text").mapInArrow(lambda batches: _pack(batches, settings), CHUNK_SCHEMA))
    size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(tasks, size["bytes"] // settings.chunk_bytes), -(-size["bytes"] // BUCKET_BYTES))
    # Read by every task, so broadcast: a number a bucket.
    splitters = docs.sparkSession.sparkContext.broadcast(_sample_splitters(chunks, size["n"], buckets, settings))

    def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _unit_rows(batches):
            yield from Unit(rows, settings).keys(splitters.value).rows(rows[0]["unit"])

    by_unit = chunks.groupBy("unit")
    round1 = keep_plan_short(chunks.mapInArrow(send_keys, SENT_SCHEMA).groupBy("bucket").applyInArrow(_find_shared(settings), REPLY_SCHEMA))

    def send_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        return _table(Unit(rows, settings).contexts(splitters.value, _replies(right, 1))[1].rows(rows[0]["unit"]) if rows else iter(()))

    round2 = keep_plan_short(by_unit.cogroup(round1.groupBy("unit")).applyInArrow(send_contexts, SENT_SCHEMA).groupBy("bucket").applyInArrow(_settle(2, settings), REPLY_SCHEMA))
    known = round1.unionByName(round2)

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return _table(iter(()))
        unit = Unit(rows, settings)
        _, opened = unit.judged(splitters.value, _replies(right, 1), _replies(right, 2))
        return _table(unit.windows(opened, splitters.value)[2].rows(rows[0]["unit"]))

    round3 = by_unit.cogroup(known.groupBy("unit")).applyInArrow(send_windows, SENT_SCHEMA).groupBy("bucket").applyInArrow(_settle(3, settings), REPLY_SCHEMA)

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        rows = left.to_pylist()
        if rows:
            unit = Unit(rows, settings)
            covered, opened = unit.judged(splitters.value, _replies(right, 1), _replies(right, 2))
            places, ids, entries = unit.windows(opened, splitters.value)
            first, _ = entries.answers(_replies(right, 3))
            gone_windows = np.split(first[entries.of] | (ids > entries.ids[entries.of]), np.cumsum([len(p) for p in places])[:-1])
            for chunk, place, doc, is_covered, at, gone_at in zip(unit.chunks, unit.place, unit.doc, covered, places, gone_windows, strict=True):
                _mark_chunk(chunk, place[is_covered], doc[is_covered], at[gone_at], out)
        return pa.table([*(pa.array(x, pa.int64()) for x in out[:4]), pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return by_unit.cogroup(known.unionByName(round3).groupBy("unit")).applyInArrow(mark, RESULT_SCHEMA)


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("bucket", pa.int64()), ("unit", pa.int64()), ("packed", pa.binary())])
    return pa.Table.from_batches(batches, schema)


def _mark_chunk(chunk: Chunk, p: np.ndarray, d: np.ndarray, at: np.ndarray, out: list[list]) -> None:
    """Add a row a document: the bytes around covered anchors ``p`` of documents ``d`` and from ``at`` on are removed."""
    low = np.maximum(chunk.start[d], p - SIDE) if len(p) else p
    high = np.minimum(p, chunk.end[d] - NEED) + NEED if len(p) else p
    edge = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(edge, np.concatenate([low, at]), 1)
    np.add.at(edge, np.concatenate([high, at + NEED]), -1)
    gone = np.cumsum(edge[:-1]) > 0
    for doc_id, a, b in zip(chunk.ids.tolist(), chunk.start.tolist(), chunk.end.tolist(), strict=True):
        cut = gone[a:b]
        spans = int(cut[:1].sum()) + int((cut[1:] & ~cut[:-1]).sum())
        kept = chunk.data[a:b][~cut].tobytes()
        for column, value in zip(out, (None if doc_id == NO_ID else doc_id, b - a, int(cut.sum()), spans, hashlib.sha256(kept).hexdigest()), strict=True):
            column.append(value)
