"""Numpy kernels over the concatenated UTF-8 bytes of many texts; all hashes are 64-bit and wrap around."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_SHIFT = np.uint64(33)
ZERO = np.uint64(0)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every bit of a hash over the whole word."""
    h = (h ^ (h >> _SHIFT)) * _MIX + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> _SHIFT)) * _ODD
    return h ^ (h >> _SHIFT)


class Powers:
    """Powers of the base and of its inverse, grown when needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse, np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base**-i over the first i bytes, for ``span_hash``."""
    _, down = POWERS(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, the same wherever they stand."""
    up, _ = POWERS(len(sums))
    return mixed((sums[end] - sums[start]) * up[start])


def gram_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram, by its first byte."""
    n = max(0, len(sums) - k)
    up, _ = POWERS(len(sums))
    return mixed((sums[k : k + n] - sums[:n]) * up[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by its first place."""
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def joined(texts: list[bytes], gap: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, each followed by ``gap`` zeros, and where each starts (and the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + gap for t in texts], out=starts[1:])
    return np.frombuffer((b"\0" * gap).join([*texts, b""]), np.uint8), starts


def groups_up_to(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose sizes add up to at most ``limit`` (or one larger one alone)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
