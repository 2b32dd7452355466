"""Word shingles as sets of 64-bit hashes, and their min-max signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = np.uint64(0xD6E8FEB86659FD93)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of ``width``-word shingles; A-Z are lower-cased, words are runs without white space of ASCII."""

    def __init__(self, width: int):
        self.width = width

    def words(self, text: str) -> np.ndarray:
        """A hash for each word, in order."""
        # bytes.lower and bytes.split know ASCII only: A-Z, and space, tab, LF, VT, FF, CR
        found = text.encode("utf-8", "surrogatepass").lower().split()
        return np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), np.uint64)

    def set_of(self, text: str | None) -> np.ndarray:
        """Distinct shingles' hashes, ascending; of fewer words the whole sequence is one; none without words."""
        words = self.words(text) if text else np.empty(0, np.uint64)
        if not len(words):
            return words
        width = min(self.width, len(words))
        h = np.full(len(words) - width + 1, width, np.uint64)
        for i in range(width):
            h = _spread(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
        return np.unique(h)


class MinMax:
    """Min-max hashing: of each permutation both the least and the greatest value are kept.

    Two values for one evaluation halve the hashing; both estimate resemblance
    without bias, and since they rarely fall on the same shingle, with no
    more variance than separate permutations have.
    """

    def __init__(self, permutations: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> bytes:
        """The low 16 bits of mixed minima and maxima in turn; none for an empty set."""
        if not len(shingles):
            return b""
        low = np.full(len(self.factors), np.uint64(0xFFFFFFFFFFFFFFFF))
        high = np.zeros(len(self.factors), np.uint64)
        for i in range(0, len(shingles), 2048):  # bounds the memory of long texts
            values = shingles[i : i + 2048][None, :] * self.factors[:, None] + self.offsets[:, None]
            np.minimum(low, values.min(1), out=low)
            np.maximum(high, values.max(1), out=high)
        return (_spread(np.stack([low, high], 1).ravel()) & np.uint64(0xFFFF)).astype("<u2").tobytes()
