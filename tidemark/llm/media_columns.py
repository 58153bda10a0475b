"""Media columns: texts as PNG images in binary columns, read back and hashed by their low frequencies.

Every text (null: empty) is encoded as UTF-8, filled up with spaces to a positive multiple of ``WIDTH`` bytes and
stored as an 8-bit greyscale PNG of that width. Reading back tests every chunk's CRC-32, the order of the chunks and
the length of the inflated data, then undoes the five row filters with numpy. The feature is a 64-bit perceptual hash:
the image averaged to 32 x 32, a two-dimensional cosine transform, its 8 x 8 lowest frequencies against their median.

Rows are independent: no shuffle, memory follows the longest text. Equal texts get equal values; repeated rows stay
repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import map_slices, texts_of

WIDTH = 192
MAGIC = b"\x89PNG\r\n\x1a\n"
IDAT_BYTES = 1 << 20
ZLIB_LEVEL = 4
SCHEMA = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_SIDE, _LOW = 32, 8
_COSINES = np.cos(np.pi * (2 * np.arange(_SIDE)[None, :] + 1) * np.arange(_LOW)[:, None] / (2 * _SIDE))


class BadImage(ValueError):
    """The bytes are no PNG that this module can read."""


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload of a text and its length before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_png(payload: bytes, width: int = WIDTH, level: int = ZLIB_LEVEL) -> bytes:
    """A greyscale PNG; every row takes the filter (none, sub, up) with the smallest sum of absolute differences."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    left = rows.copy()
    left[:, 1:] -= rows[:, :-1]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = np.stack([np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1) for x in (rows, left, up)])
    kind = cost.argmin(axis=0).astype(np.uint8)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], left, up))
    data = zlib.compress(lines.tobytes(), level)
    parts = [MAGIC, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def chunks_of(png: bytes) -> list[tuple[bytes, bytes]]:
    """The chunks of a PNG, each with its checksum tested."""
    if png[:8] != MAGIC:
        raise BadImage("signature")
    out, at = [], 8
    while at < len(png):
        if at + 12 > len(png):
            raise BadImage("truncated chunk")
        (n,), kind = struct.unpack_from(">I", png, at), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        if len(body) != n or at + 12 + n > len(png):
            raise BadImage("truncated chunk")
        if struct.unpack_from(">I", png, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise BadImage(f"checksum of {kind!r}")
        out.append((kind, body))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1] != (b"IEND", b""):
        raise BadImage("order of chunks")
    return out


def unfilter(kinds: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Undo PNG's row filters for one byte a pixel; runs of rows with one filter are handled at once."""
    out = np.empty_like(lines)
    cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        kind, above = int(kinds[a]), out[a - 1] if a else np.zeros(lines.shape[1], np.uint8)
        if kind == 0:
            out[a:b] = lines[a:b]
        elif kind == 1:
            out[a:b] = np.cumsum(lines[a:b], axis=1, dtype=np.uint8)
        elif kind == 2:
            out[a:b] = np.cumsum(lines[a:b], axis=0, dtype=np.uint8) + above
        elif kind in (3, 4):
            for i in range(a, b):
                out[i] = _one_row(kind, lines[i].tolist(), (out[i - 1] if i else above).tolist())
        else:
            raise BadImage(f"row filter {kind}")
    return out


def _one_row(kind: int, line: list[int], above: list[int]) -> list[int]:
    left = corner = 0
    row = []
    for x, up in zip(line, above, strict=True):
        if kind == 3:
            guess = (left + up) // 2
        else:
            toward = left + up - corner
            a, b, c = abs(toward - left), abs(toward - up), abs(toward - corner)
            guess = left if a <= b and a <= c else up if b <= c else corner
        left, corner = (x + guess) & 255, up
        row.append(left)
    return row


def read_png(png: bytes) -> np.ndarray:
    """The samples of an 8-bit greyscale PNG without interlacing."""
    chunks = chunks_of(png)
    width, height, *rest = struct.unpack(">IIBBBBB", chunks[0][1])
    if rest != [8, 0, 0, 0, 0]:
        raise BadImage("kind of image")
    inflate = zlib.decompressobj()
    data = inflate.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    if not inflate.eof or inflate.unused_data or len(data) != height * (width + 1):
        raise BadImage("length of the samples")
    lines = np.frombuffer(data, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:])


def low_frequencies(image: np.ndarray) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies exceed their median; the constant term is left out."""
    height, width = image.shape
    rows = (np.arange(_SIDE) * height) // _SIDE
    if height >= _SIDE:
        mean = np.add.reduceat(image, rows, axis=0, dtype=np.int64) / np.diff([*rows, height])[:, None]
    else:
        mean = image[rows].astype(np.float64)
    small = mean.reshape(_SIDE, _SIDE, width // _SIDE).mean(axis=2)
    waves = (_COSINES @ small @ _COSINES.T).ravel().round(6)
    bits = waves > np.median(waves[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(9)]
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
        payload, n_bytes = payload_of(text)
        png = write_png(payload)
        image = read_png(png)
        back = image.tobytes()
        row = (doc_id, n_bytes, png, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(png), hashlib.sha256(png).hexdigest(), low_frequencies(image))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)


def media_columns(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) to one row a document with the PNG in ``media`` and what was read back from it."""
    return map_slices(docs.select("doc_id", "text"), _features, SCHEMA, rows=64)
