"""Word shingles as sorted 64-bit hashes: the sets that near-duplicate operators compare."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

CACHE_WORDS = 300_000


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words seen before; emptied by ``trim`` when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers, so that high bits are uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a text.

    A-Z become lower case; words are runs without the characters 0x20 and 0x09-0x0D (what bytes.split gives).
    A text of fewer words is one shingle; a text without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    at = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    width = min(size, len(found))
    total = np.zeros(len(found) - width + 1, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + at[i:len(at) - width + 1 + i]
    return np.unique(mixed(total + np.uint64(width)))


def set_key(shingles: np.ndarray) -> bytes | None:
    """128-bit digest of a set; None for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
