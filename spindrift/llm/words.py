"""Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 columns, and 64-bit hashes of words and word windows, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, read from prefix sums, then mixed; a window's hash is
a polynomial over its words' hashes.  No step loops over words.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_random = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _random.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
FOLDED_CODES = BYTE_CODES.copy()
FOLDED_CODES[65:91] = BYTE_CODES[97:123]
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            self.up, self.down = (self._run(b, size) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)


_byte_powers = _Powers(BYTE_BASE)
_window_powers = tuple(_Powers(b) for b in WINDOW_BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it (n + 1)."""
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    lead = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[lead] = inside[lead]
    tail = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tail] = inside[tail]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """Each word's hash; ``fold`` takes A-Z as a-z."""
    up, down = _byte_powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((FOLDED_CODES if fold else BYTE_CODES)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of words[i : i + width] for each i; windows across rows are the caller's to leave out."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = _window_powers[which].to(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(words) - width + 1] + U(width))


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each row."""
    return np.diff(bounds(data, offsets)[2])
