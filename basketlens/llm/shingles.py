"""Hashes of words and word shingles, in numpy, for use within tasks."""

from __future__ import annotations

import numpy as np

WORDS_KEPT = 500_000
#: Odd multipliers (fixed values of the splitmix64 generator and its increment).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def stepped(number: int) -> np.uint64:
    return np.uint64(number * int(STEP) & 0xFFFFFFFFFFFFFFFF)


def mixed(values: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a permutation of 64-bit numbers that spreads their bits."""
    values = (values ^ (values >> np.uint64(30))) * MIX_A
    values = (values ^ (values >> np.uint64(27))) * MIX_B
    return values ^ (values >> np.uint64(31))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, text: str) -> np.ndarray:
        """Hashes of the words between ASCII white space, A-Z taken as a-z."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of all words if there are fewer, but not none."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    total = np.full(n, stepped(size), dtype=np.uint64)
    for i in range(size):
        total = mixed(total + words[i : i + n] + stepped(i + 1))
    return total
