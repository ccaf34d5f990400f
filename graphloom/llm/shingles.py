"""Word shingles of the near-duplicate operators as sets of 64-bit hashes.

Words follow the shared contract: A-Z are lower-cased (nothing else is), words
are maximal runs of ``[^\\x20\\x09-\\x0D]``.  On UTF-8 bytes that is exactly
``bytes.lower().split()``, as both treat ASCII only.

A shingle stands for itself by a 64-bit hash.  Two different shingles of one
pair of documents collide with a probability of about 1e-13; then a set
counts one element less.
"""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash per word of a UTF-8 text, in order; words may repeat."""
    words = raw.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of k words, in order; fewer words are one run."""
    n = words.size
    if not n:
        return words
    width = min(k, n)
    m = n - width + 1
    h = np.full(m, np.uint64(width))
    for i in range(width):
        h = h * _STEP + words[i : i + m]
    return mix(h)


def shingle_set(raw: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    return np.unique(shingle_hashes(word_hashes(raw or b""), k))
