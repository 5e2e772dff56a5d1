"""Word shingles of whole texts as sets of 64-bit numbers, for batches of rows inside a task."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

MEMO_WORDS = 500_000
_A = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the word; wraps around as intended."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_MEMO = _Words()


def words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only and splits at space and \\x09 to \\x0D only, as bytes methods do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct shingles of k words; with fewer words the sequence as one; none without words."""
    own = words(text)
    n = len(own)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_MEMO.__getitem__, own), np.uint64, n)
    size = min(n, k)
    acc = h[: n - size + 1].copy()
    for j in range(1, size):
        acc = acc * _A + h[j: n - size + 1 + j]
    return np.unique(mix(acc ^ np.uint64(size * 0x51ED270B)))


def digest(values: np.ndarray) -> int:
    """A signed 64-bit number of a whole set."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)
