"""Hashes of words, shingles and signatures in numpy, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_KNOWN: dict[str, int] = {}
#: Words a worker remembers; beyond that it starts anew, with the same hashes.
REMEMBERED = 400_000


def word_hashes(words: list[str]) -> np.ndarray:
    """64 bits per word, the same in every process."""
    known = _KNOWN
    if len(known) > REMEMBERED:
        known.clear()
    digest = xxhash.xxh3_64_intdigest
    for w in set(words).difference(known):
        known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a public finalizer of 64-bit generators)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; a shorter text is one run; no word, none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = word_hashes(words)
    n = min(n, len(h))
    run = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(run))


def set_hash(sorted_hashes: np.ndarray) -> int:
    """One signed long for a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(sorted_hashes.tobytes(), len(sorted_hashes) & 0xFFFF)).astype(np.int64))
