"""Hashes of word shingles, many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A text's
shingles are its runs of ``width`` words; one with fewer words has its whole
sequence as the only shingle, one without words none. A shingle's hash mixes the
64-bit hashes of its words with a multiplier for each place.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from xxhash import xxh3_64_intdigest

def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the public splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def place_factors(width: int) -> np.ndarray:
    return mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' shingles in order, repeated ones included, and where each text's begin (one more than texts)."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(begins[-1]))
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    factors = place_factors(width)
    with np.errstate(over="ignore"):
        runs = np.zeros(max(0, len(flat) - width + 1), np.uint64)
        for j in range(width):
            runs += flat[j : j + len(runs)] * factors[j]
        out = np.empty(int(offsets[-1]), np.uint64)
        at = np.repeat(begins[:-1] - offsets[:-1], counts) + np.arange(len(out))
        whole = np.repeat(sizes >= width, counts)
        out[whole] = runs[at[whole]]
        for d in np.flatnonzero((sizes > 0) & (sizes < width)):
            n = int(sizes[d])
            out[offsets[d]] = (flat[begins[d] : begins[d] + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)
    return mixed(out), offsets


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles in ascending order of hash."""
    hashes, offsets = shingle_hashes(texts, width)
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
