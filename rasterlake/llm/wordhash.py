"""Vectorised words, word hashes and shingles of a batch of texts.

Words are runs of bytes other than space and \\x09-\\x0D, which on UTF-8 is the same as
the character class ``[^\\x20\\x09-\\x0D]+``. A word's 64-bit hash is a polynomial over
its (A-Z lowered) bytes modulo 2**64 with random byte values, finalised by a bijective
mixer; shingles combine k word hashes linearly and mix again.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SLOT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(_BASE, -1, 2**64)
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


class Words:
    """All words of a batch: byte spans, document numbers, and where each document's words begin."""

    def __init__(self, texts: list[str | None], lower: bool = True):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        self.doc_start, self.doc_end = ends - np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)), ends - 1
        gap = np.ones(len(self.buf) + 2, bool)
        gap[1:-1] = _IS_SPACE[self.buf]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.last = np.searchsorted(self.start, self.doc_end)
        self.lower = lower

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        table = _LOWER if self.lower else _BYTE
        step = 1 << 22
        k = 0
        while k < len(self.start):  # blocks of a few megabytes keep the power tables small
            base = self.start[k]
            stop = max(int(np.searchsorted(self.end, base + step, "right")), k + 1)
            lo, hi = int(base), int(self.end[stop - 1])
            power, inverse = _powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table[self.buf[lo:hi]] * power[: hi - lo], out=total[1:])
            s, e = self.start[k:stop] - lo, self.end[k:stop] - lo
            out[k:stop] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            k = stop
        return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words (also those that cross documents: callers slice)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n] * _SLOT[0]
    for j in range(1, k):
        out += hashes[j : j + n] * _SLOT[j]
    return mix(out)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; shorter texts are one shingle, no words none."""
    words = Words(texts)
    h = words.hashes()
    w = window_hashes(h, k)
    out = []
    for a, b in zip(words.first.tolist(), words.last.tolist(), strict=True):
        n = b - a
        if n >= k:
            s = np.sort(w[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif n:
            out.append(mix((h[a:b] * _SLOT[1 : n + 1]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
