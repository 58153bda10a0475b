"""Secret scans: three fixed kinds of pattern, and strings that zstandard cannot shorten in sensitive places.

Base kinds, leftmost and non-overlapping per kind: ``assign`` (a key name, a sign and a value of 8 or more characters),
``access`` (AKIA and capitals or digits, 16 or more), ``hex`` (32 or more lowercase hex digits).

``novel`` adds to them. A candidate is a whole run of ``SHORTEST`` or more characters (letters, digits and ``+/_.-``, with
up to two ``=`` behind) that has letters, lies in no base match, is no UUID, and has a sensitive word in it or at most
``CONTEXT`` characters before it. Its novelty is its marginal cost: the bytes of (text before + text after + candidate)
compressed, less those of the text around alone, a byte of the candidate's length. Texts are compressed as words: split at
changes of case, between letters and digits and at other signs, in lower case. The compressor is primed with a zstandard
dictionary (matches, literal and match statistics) that is trained on ordinary names and prose, taken from the documentation
of the modules in ``ORDINARY_MODULES``, and on the words of which the corpus's own identifiers are made: the ``MOST_WORDS`` that
the most documents have in long runs, in two documents at least. So names of ordinary words are cheap, and random strings
are not; a secret that many copies repeat has no such words and stays novel. ``NOVELTY`` was chosen between held-out
strings: names made of words of another library's documentation (all but one in 300 below) and random strings of six
alphabets (all but one in 300 above).

The words are counted over all documents, pre-aggregated before their shuffle, and the dictionary (bounded by ``DICTIONARY``) is
broadcast. Scanning itself needs no shuffle. Null texts are empty, very long texts are scanned whole in time that grows
with their length, repeated rows stay repeated, an empty table gives an empty result, only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import map_slices, of_texts, texts_of, with_small_batches

KINDS = ("assign", "access", "hex", "novel")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
CONTEXT = 64
NOVELTY = 0.76
SHORTEST = 20
#: Words of the corpus's identifiers in the dictionary, and documents that must have one.
MOST_WORDS, LEAST_DOCUMENTS = 4096, 2
#: Bytes of the dictionary, and how often it is shown the corpus's words.
DICTIONARY, SHOWN = 131_072, 6
#: Modules whose documentation shows ordinary names and prose.
ORDINARY_MODULES = """argparse ast asyncio base64 calendar codecs collections configparser contextlib csv datetime decimal difflib email
enum fractions ftplib functools getpass gettext glob gzip hashlib heapq hmac html http.client http.cookies http.server imaplib
inspect io ipaddress itertools json locale logging logging.handlers mailbox math mimetypes multiprocessing optparse os os.path pathlib
pickle platform plistlib poplib pprint queue random re sched secrets select selectors shelve shutil signal smtplib socket socketserver
sqlite3 ssl statistics string subprocess sys tarfile tempfile textwrap threading time timeit tokenize trace traceback types typing
unittest unittest.mock urllib.error urllib.parse urllib.request uuid warnings wave weakref xml.dom.minidom xml.etree.ElementTree
xmlrpc.client zipfile""".split()

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A run that is long enough to be a key.
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.-]{{{SHORTEST},}}={{0,2}}")
_SENSITIVE = re.compile(r"(?ai)secret|token|passw|api.?key|credential|private|auth|bearer|access.?key|signature|session")
_UUID = re.compile(r"(?ai)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_BORDERS = re.compile(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|[^\w]+|_+")


def as_words(text: str) -> bytes:
    """The text in lower case, cut at changes of case, at borders of numbers and at other signs."""
    return " ".join(_BORDERS.sub(" ", text).split()).lower().encode("utf-8", "replace")


def ordinary_samples() -> list[bytes]:
    """Names and documentation of ORDINARY_MODULES as words."""
    samples = []
    for name in ORDINARY_MODULES:
        try:
            module = importlib.import_module(name)
        except ImportError:  # a module that this Python was built without only shows less
            continue
        samples.append(as_words(module.__doc__ or name))
        for each in dir(module):
            value = getattr(module, each, None)
            samples.append(as_words(f"{each} {(inspect.getdoc(value) or '')[:400] if callable(value) else ''}"))
    return [s[:2000] for s in samples if len(s) > 8]


@lru_cache(4)
def trained_dictionary(words: bytes = b"") -> bytes:
    """A dictionary of ordinary text and of ``words``, trained once on the driver."""
    own = words.split()
    shown = [b" ".join(own[i : i + 16]) for i in range(0, len(own), 16)] * SHOWN
    return zstandard.train_dictionary(DICTIONARY, ordinary_samples() + shown).as_bytes()


_COMPRESSORS: dict[bytes, zstandard.ZstdCompressor] = {}


def _cost(data: bytes, primed: bytes) -> int:
    if primed not in _COMPRESSORS:  # a compressor can't be sent to a task; each process makes its own
        _COMPRESSORS.clear()
        _COMPRESSORS[primed] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(primed), write_content_size=False, write_dict_id=False)
    return len(_COMPRESSORS[primed].compress(data))


def identifier_words(docs: DataFrame) -> bytes:
    """The words that the most documents have inside long runs, the most frequent last (nearest to what is compressed)."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-z0-9+/_=.-]{{{SHORTEST},}}"), F.lit(0))
    words = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit("[A-Za-z][a-z]{2,}"), F.lit(0)))))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    best = counted.where(F.length("word") <= 32).orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    return " ".join(r["word"] for r in reversed(best)).encode()


def novelty(before: str, candidate: str, after: str, primed: bytes) -> float:
    """Marginal compressed bytes of the candidate beside the text around it, a byte of its length."""
    around = as_words(f"{before} {after}") + b" "
    return (_cost(around + as_words(candidate), primed) - _cost(around, primed)) / len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base matches."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


def novel_spans(text: str, base: list[tuple[int, int, str]], primed: bytes) -> list[tuple[int, int, str]]:
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted((a, b) for a, b, _ in base)
    reach, far = [], 0
    for _, b in taken:
        reach.append(far := max(far, b))
    found = []
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        # The first sensitive word that ends behind the context's start must begin before the run's end.
        word = bisect_left(ends, a - CONTEXT)
        if word == len(words) or starts[word] >= b:
            continue
        at = bisect_right(taken, (a, len(text))) - 1  # base matches that start at or before the run
        if (at >= 0 and reach[at] >= b) or not re.search("[A-Za-z]", m[0]) or _UUID.fullmatch(m[0]):
            continue
        if novelty(text[max(0, a - CONTEXT) : a], m[0], text[b : b + CONTEXT], primed) >= NOVELTY:
            found.append((a, b, "novel"))
    return found


def secret_spans(text: str, primed: bytes | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed in KINDS."""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, trained_dictionary() if primed is None else primed), key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, primed: bytes | None = None) -> str:
    """The text with every reported stretch (overlapping ones as one) replaced by a mark."""
    out, at = [], 0
    for a, b, kind in secret_spans(text, primed):
        if a >= at:
            out += [text[at:a], f"[{kind} secret removed]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def _shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scan(batch: pa.RecordBatch, primed: bytes) -> pa.RecordBatch:
    spans = [secret_spans(t, primed) for t in texts_of(batch)]
    base = [[s for s in x if s[2] != "novel"] for x in spans]
    counts = [pa.array([sum(s[2] == kind for s in x) for x in spans], pa.int64()) for kind in KINDS[:3]]
    digests = [hashlib.sha256(_shown(x).encode()).hexdigest() for x in base]
    return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *counts, pa.array(digests, pa.string()), pa.array(list(map(_shown, spans)), pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """``docs`` (doc_id, text) to counts and spans of secrets, one row a document; ``words``: those of another corpus."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_dictionary(identifier_words(docs) if words is None else words))
    return map_slices(docs.select("doc_id", "text"), lambda batch: _scan(batch, shared.value), SCHEMA)


def redact_secrets(docs: DataFrame, words: bytes | None = None) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by marks; other columns (``n_chars`` follows the text) stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trained_dictionary(identifier_words(docs) if words is None else words))

    with_small_batches(docs.sparkSession)
    out = docs.withColumn("text", of_texts(F.col("text"), lambda texts: [None if t is None else redacted(t, shared.value) for t in texts], "string"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
