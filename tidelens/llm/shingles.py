"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once in numpy.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A word's hash is a polynomial in its
bytes modulo 2^64, taken from running sums; a shingle's is a polynomial in the hashes of its words. A text of fewer
words than a shingle has its whole word sequence as its one shingle; a text without words has none.
"""

from __future__ import annotations

import numpy as np

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
ROOT = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD1B54A32D192ED03)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, words: int = 5):
        self.words = words
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            def powers(root: int) -> np.ndarray:
                steps = np.full(n, root % (1 << 64), np.uint64)
                steps[0] = 1
                return np.cumprod(steps, dtype=np.uint64)

            self.power, self.inverse = powers(ROOT), powers(pow(ROOT, -1, 1 << 64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """The sorted distinct shingle hashes (uint64) of each text data[starts[k]:ends[k]]; texts lie in order."""
        if not len(starts):
            return []
        base = int(starts[0])
        text, starts, ends = FOLD[data[base : int(ends.max(initial=base))]], starts - base, ends - base
        n = len(text)
        word = ~SPACE[text]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = starts[(starts < n) & (starts < ends)]
        first[inside] = word[inside]
        last = word.copy()  # last byte of a word
        last[:-1] &= ~word[1:]
        tails = ends[(ends > starts)] - 1
        last[tails] = word[tails]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=sums[1:])
        h = mixed((sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * STEP)
        low, high = np.searchsorted(a, starts), np.searchsorted(a, ends)
        k, m = self.words, len(h)
        out = []
        if m >= k:
            s = h[: m - k + 1].copy()
            for j in range(1, k):
                s = s * STEP + h[j : m - k + 1 + j]
            s = mixed(s + np.uint64(k))
        for lo, hi in zip(low.tolist(), high.tolist(), strict=True):
            if hi - lo >= k:
                out.append(np.unique(s[lo : hi - k + 1]))
            elif hi > lo:
                whole = 0
                for x in h[lo:hi].tolist():
                    whole = (whole * int(STEP) + x) % (1 << 64)
                out.append(mixed(np.array([(whole + hi - lo) % (1 << 64)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
