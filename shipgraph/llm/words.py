"""Words and word-window hashes of many documents at once, in numpy.

A word's hash is a polynomial over its bytes, taken as the difference of two
prefix sums modulo 2^64 and then mixed; a window's hash is the same over the
word hashes.  Equal words (windows) have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
U = np.uint64


def table(separators: bytes) -> np.ndarray:
    """True for each byte that belongs to a word."""
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


SPACE_WORDS = table(SPACES)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


LETTERS, TWIN = Powers(0x9E3779B97F4A7C15 | 1), Powers(0xC2B2AE3D27D4EB4F | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the words, and each document's bounds among them."""
    w = is_word[data]
    n = len(w)
    first = w.copy()
    first[1:] &= ~w[:-1]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = w[inner]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[inner - 1] = w[inner - 1]
    st, en = np.flatnonzero(first), np.flatnonzero(last) + 1
    return st, en, np.searchsorted(st, off)


def word_hashes(data: np.ndarray, st: np.ndarray, en: np.ndarray,
                powers: Powers = LETTERS) -> np.ndarray:
    up, down = powers.get(len(data) + 1)
    c = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=c[1:])
    return mix((c[en] - c[st]) * down[st] + (en - st).astype(U))


def window_hashes(h: np.ndarray, k: int, powers: Powers = LETTERS) -> np.ndarray:
    """Hash of each run of ``k`` words, by the place of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers.get(len(h))
    c = np.zeros(len(h) + 1, U)
    np.cumsum(h * up, out=c[1:])
    return mix((c[k:] - c[:n]) * down[:n] + U(k))


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows that lie within one document, and the documents."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(bounds[0], bounds[-1])
    ok = at + k <= np.repeat(bounds[1:], n)
    return at[ok], doc[ok]
