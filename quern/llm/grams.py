"""Hashed words and word n-grams of whole texts, in numpy without a Python object per word.

A word is a run of ASCII letters and digits and of any characters outside
ASCII, in lower case.
"""

from __future__ import annotations

import numpy as np

WORD = "[a-z0-9\\x{80}-\\x{10FFFF}]+"  # as a pattern of RE2, over lower-cased text

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_KEEP = np.zeros(256, bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))
#: Bytes of a text that are hashed at a time: a long one takes little more memory than its words' hashes.
PORTION = 1 << 18


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(12, n.bit_length())
        _powers = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def words(text: str | None) -> np.ndarray:
    """The hash of each word, in the order of the text: differences of a rolling hash over portions of whole words.

    A word's hash doesn't depend on where in a portion it lies; one longer than a portion is added up from pieces.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8)
    edge = np.flatnonzero(np.diff(_KEEP[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        a = start[at]
        to = max(at + 1, int(np.searchsorted(end, a + PORTION, "right")))
        b = end[to - 1]
        power, inverse = _power(int(min(b - a, PORTION)))
        if b - a > PORTION:
            pieces = (int((_BYTE[raw[p : min(b, p + PORTION)]] * power[: min(b - p, PORTION)]).sum()) * pow(_BASE, int(p - a), 1 << 64) for p in range(a, b, PORTION))
            out[at] = sum(pieces) % (1 << 64)
        else:
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[raw[a:b]] * power[: b - a], out=sums[1:])
            out[at:to] = (sums[end[at:to] - a] - sums[start[at:to] - a]) * inverse[start[at:to] - a]
        at = to
    return mix(out)


def gram_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; of fewer than n words, one of them all; of none, empty."""
    w = words(text)
    if not len(w):
        return w
    n = min(n, len(w))
    g = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        g = mix(g * _STEP + w[k : len(w) - n + 1 + k])
    g.sort()
    return g[np.concatenate([[True], g[1:] != g[:-1]])]
