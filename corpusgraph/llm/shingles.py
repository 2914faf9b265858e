"""Words of a text and Karp-Rabin hashes of runs of words, vectorised over one text."""

from __future__ import annotations

import re

import numpy as np

#: Words are runs of word characters of the lower-cased text.
_WORD = re.compile(r"\w+")
#: Fixed odd multipliers of the rolling hash and of the finisher.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_up = np.ones(1, np.uint64)
_down = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = max(n, 2 * len(_up), 1 << 15)
        _up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE))])
        _down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE_INVERSE))])
    return _up, _down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64 bits, modulo 2**64 as all arithmetic here."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Rolled:
    """The words of one text with prefix sums, from which any run of words gets its hash in constant time."""

    __slots__ = ("words", "_sums", "_start", "_end", "_down", "raw")

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.raw = " ".join(words).encode("utf-8", "surrogatepass")
        b = np.frombuffer(self.raw, np.uint8)
        up, self._down = _powers(len(b) + 1)
        self._sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=self._sums[1:])
        gaps = np.flatnonzero(b == 32)
        self._start = np.concatenate([[0], gaps + 1]) if words else np.zeros(0, np.int64)
        self._end = np.concatenate([gaps, [len(b)]]) if words else np.zeros(0, np.int64)

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words, in order; empty if there are fewer words."""
        k = len(self.words) - n + 1
        if k <= 0:
            return np.zeros(0, np.uint64)
        s, e = self._start[:k], self._end[n - 1 :]
        return mix((self._sums[e] - self._sums[s]) * self._down[s])

    def shingles(self, n: int) -> np.ndarray:
        """Hashes of runs of ``n`` words with repeats; a shorter text has one run of all its words, an empty one none."""
        return self.runs(min(n, len(self.words))) if self.words else np.zeros(0, np.uint64)
