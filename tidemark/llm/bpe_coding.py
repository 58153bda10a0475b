"""BPE encoding and decoding by speculation: propose greedily, check every adjacent pair, merge only what fails.

The vocabulary is a tokenizers-library JSON file of a BPE model with an end-of-word suffix, lower-casing and byte-level
letters; its path is a parameter. The driver reads it and broadcasts it (a few MB, bounded by the vocabulary). Text
goes through the file's own steps: special tokens are cut out as they stand, the rest is put into NFC and lower-cased,
words are taken by the file's pattern.

A word that a task has not met yet gets tokens by greedy longest match. A sequence of tokens is what merging by rank
would give if every token re-encodes to itself and every adjacent pair does so as a pair; numpy tests the pairs of all
new words at once, by undoing merges from the latest back and looking for an earlier merge across the border. Words
with a failing pair, or with a token that does not re-encode to itself, are merged exactly, with a heap.

Rows are independent: no shuffle. A task keeps at most ``CACHE_WORDS`` words. Null texts are empty (no ids); very long
words are merged in n log n; repeated rows stay repeated; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.frames import SLICE_ROWS, map_slices, texts_of

CACHE_WORDS = 400_000
#: Up to so many letters a list of ranks is faster than a heap.
SHORT = 48
SCHEMA = "doc_id long, ids array<int>, decoded string"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: The word pattern of the file, with the space class spelt out by its Unicode property.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: The same pattern for the standard library's faster engine, right where no character is of a kind that the two see differently.
_PLAIN_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _differing() -> frozenset[str]:
    """Characters that re's classes sort otherwise than \\p{L}, \\p{N} and \\p{White_Space} do."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    kinds = ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}"))
    return frozenset().union(*(set(re.findall(a, every)) ^ set(regex.findall(b, every)) for a, b in kinds))


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable in Latin-1, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@dataclass
class Model:
    """What a task needs of the vocabulary. rank: -1 for single letters; left, right: the merge that makes a token."""

    ids: dict[str, int]
    tokens: list[str]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    merges: dict[tuple[int, int], tuple[int, int]]
    specials: dict[str, int]
    suffix: str
    prefixes: dict[str, int]
    unstable: frozenset[int] = frozenset()
    cache: dict[str, tuple[str, int, str]] = field(default_factory=dict)
    cache_words: int = CACHE_WORDS


def load_model(path: str) -> Model:
    """Read a vocabulary file on the driver."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    m, suffix = data["model"], data["model"]["end_of_word_suffix"] or ""
    specials = {x["content"]: x["id"] for x in data["added_tokens"]}
    size = max([*m["vocab"].values(), *specials.values()]) + 1
    tokens = [""] * size
    for token, i in [*m["vocab"].items(), *specials.items()]:
        tokens[i] = token
    rank, left, right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    merges = {}
    for n, pair in enumerate(m["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        made = m["vocab"][a + b]
        rank[made], left[made], right[made] = n, m["vocab"][a], m["vocab"][b]
        merges[m["vocab"][a], m["vocab"][b]] = (n, made)
    keys = np.array([a * size + b for a, b in merges], np.int64)
    order = np.argsort(keys)
    ranks = np.array([r for r, _ in merges.values()], np.int64)
    prefixes: dict[str, int] = {}
    for token, i in m["vocab"].items():
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) and token != suffix else token
        for n in range(1, len(body) + 1):
            prefixes.setdefault(body[:n], -1)
        if body == token:
            prefixes[token] = i
    model = Model(m["vocab"], tokens, rank, left, right, keys[order], ranks[order], merges, specials, suffix, prefixes)
    model.unstable = frozenset(i for i in m["vocab"].values() if rank[i] >= 0 and merge_exactly(model, _letters(model, tokens[i])) != [i])
    return model


def _letters(model: Model, token: str) -> list[int]:
    """A token's string as ids of single letters, the suffix with the last one."""
    ends = bool(model.suffix) and token.endswith(model.suffix) and len(token) > len(model.suffix)
    body = token[: -len(model.suffix)] if ends else token
    return [model.ids[c + (model.suffix if ends and i == len(body) - 1 else "")] for i, c in enumerate(body)]


def _merge_short(model: Model, ids: list[int]) -> list[int]:
    """The same for short words: the ranks of all neighbours in a list."""
    merges, none = model.merges, (1 << 60, -1)
    ranks = [merges.get(pair, none) for pair in zip(ids, ids[1:])]
    while ranks:
        best = min(ranks)
        if best is none:
            break
        i = ranks.index(best)
        ids[i : i + 2] = [best[1]]
        del ranks[i]
        if i:
            ranks[i - 1] = merges.get((ids[i - 1], ids[i]), none)
        if i < len(ranks):
            ranks[i] = merges.get((ids[i], ids[i + 1]), none)
    return ids


def merge_exactly(model: Model, ids: list[int]) -> list[int]:
    """Merge by rank, leftmost first, in n log n."""
    n, ids = len(ids), list(ids)
    if n <= SHORT:
        return _merge_short(model, ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*model.merges[pair], i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in model.merges]
    heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (ids[x], ids[y]) in model.merges:
                rank, new = model.merges[ids[x], ids[y]]
                heapq.heappush(heap, (rank, x, new, ids[x], ids[y]))
    return [x for x in ids if x >= 0]


def propose(model: Model, word: str) -> list[int]:
    """Greedy longest match over byte letters; the last token carries the suffix."""
    ids, at, n, prefixes = [], 0, len(word), model.prefixes
    while at < n:
        found, stop = -1, at
        for end in range(at + 1, n + 1):
            part = word[at:end]
            token = prefixes.get(part)
            if token is None:
                break
            if end == n:
                token = model.ids.get(part + model.suffix, -1)
            if token >= 0:
                found, stop = token, end
        if found < 0:
            raise KeyError(f"no token for {word[at]!r}")
        ids.append(found)
        at = stop
    return ids


def compatible(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging would leave each pair of tokens as it is.

    Undo the later of the two tokens' last merges, again and again; at every step the two tokens at the border stand
    side by side until ``limit``, the rank of the merge just undone. A merge across the border of a lower rank would
    have come first. At equal rank the leftmost merge comes first: the one across the border if the right token was undone.
    """
    a, b = a.copy(), b.copy()
    good = np.ones(len(a), bool)
    limit = np.full(len(a), np.iinfo(np.int64).max)  # twice the rank, plus one if the right token was undone
    live = np.arange(len(a))
    size = len(model.tokens)
    while len(live):
        x, y = a[live], b[live]
        key = x * size + y
        at = np.minimum(np.searchsorted(model.pair_keys, key), len(model.pair_keys) - 1)
        crosses = (model.pair_keys[at] == key) & (2 * model.pair_ranks[at] < limit[live])
        good[live[crosses]] = False
        go = ~crosses & ((model.rank[x] >= 0) | (model.rank[y] >= 0))
        live, x, y = live[go], x[go], y[go]
        first = model.rank[x] > model.rank[y]
        limit[live] = np.where(first, 2 * model.rank[x], 2 * model.rank[y] + 1)
        a[live] = np.where(first, model.right[x], x)
        b[live] = np.where(first, y, model.left[y])
    return good


def encode_words(model: Model, words: list[str]) -> list[list[int]]:
    """Tokens of words given as byte letters: speculate, verify all at once, mend what fails."""
    ids = [propose(model, w) for w in words]
    if not ids:
        return ids
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))
    word = np.repeat(np.arange(len(ids)), sizes)
    inner = np.flatnonzero(word[1:] == word[:-1])
    failing = set(word[inner[~compatible(model, flat[inner], flat[inner + 1])]].tolist())
    if model.unstable:
        failing |= set(word[np.isin(flat, list(model.unstable))].tolist())
    for i in failing:
        ids[i] = merge_exactly(model, _letters(model, words[i] + model.suffix))
    return ids


_LETTER = dict(enumerate(byte_letters()))
_ODD = _differing()


def normal(text: str) -> str:
    """NFC, then lower case letter by letter (a final sigma is no exception)."""
    text = text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def words_of(text: str) -> list[str]:
    return (_PLAIN_WORDS if _ODD.isdisjoint(text) else _WORDS).findall(text)


def pieces_of(model: Model, text: str) -> list[str]:
    """The words and special tokens of a text, in order; special tokens as they stand."""
    if not any(s in text for s in model.specials):
        return words_of(normal(text))
    out: list[str] = []
    for i, part in enumerate(re.split("(" + "|".join(map(re.escape, sorted(model.specials, key=len, reverse=True))) + ")", text)):
        out += [part] if i % 2 else words_of(normal(part))
    return out


def learn(model: Model, words: set[str]) -> None:
    """Put new words into the cache: ids as text, their number, the decoded form."""
    new = [w for w in words if w not in model.cache]
    if len(model.cache) + len(new) > model.cache_words:
        model.cache.clear()
        new = list(words)
    for s, i in model.specials.items():
        model.cache[s] = (str(i), 1, s)
    plain = [w for w in new if w not in model.specials]
    spelt = [w if w.isascii() and w.isprintable() else "".join(_LETTER[b] for b in w.encode("utf-8", "surrogatepass")) for w in plain]
    for w, ids in zip(plain, encode_words(model, spelt), strict=True):
        model.cache[w] = (" ".join(map(str, ids)), len(ids), " ".join(model.tokens[i] for i in ids))


def code_texts(model: Model, texts: list[str]) -> list[tuple[str, int, str]]:
    """For each text: ids joined by spaces, their number, and the decoded text.

    The file has no decoder: tokens are joined by spaces.
    """
    pieces = [pieces_of(model, t) for t in texts]
    learn(model, set().union(*pieces))
    out = []
    for p in pieces:
        coded = [model.cache[x] for x in p]
        out.append((" ".join([c[0] for c in coded]), sum([c[1] for c in coded]), " ".join([c[2] for c in coded])))
    return out


def decode_ids(model: Model, ids: list[int]) -> str:
    return " ".join(model.tokens[i] for i in ids)


def _shared(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS):
    model = load_model(path)
    model.cache_words = cache_words
    return docs.sparkSession.sparkContext.broadcast(model)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, ids, decoded; decoded is made from the ids."""
    shared = _shared(docs, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        ids = [[int(x) for x in c[0].split()] for c in code_texts(model, texts_of(batch))]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([decode_ids(model, x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return map_slices(docs.select("doc_id", "text"), work, SCHEMA)


def bpe_digests(docs: DataFrame, path: str, cache_words: int = CACHE_WORDS, rows: int = SLICE_ROWS) -> DataFrame:
    """The same as counts and hashes, without the ids leaving the task.

    ``cache_words`` words and ``rows`` texts are held at a time: fewer take less memory and more time.
    """
    shared = _shared(docs, path, cache_words)
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        coded = code_texts(shared.value, texts_of(batch))
        return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([c[1] for c in coded], pa.int64()), pa.array([sha(c[0]) for c in coded]), pa.array([sha(c[2]) for c in coded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_slices(docs.select("doc_id", "text"), work, DIGEST_SCHEMA, rows)
