"""Vectorised word shingles: hashes of word windows and MinHash band values for whole Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_PAD = np.uint64(0x5851F42D4C957F2D)


class WordIds(dict):
    """Stable 64-bit ids of words, remembered for as long as a batch lives."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def window_hashes(docs: list[list[int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words: (hash, document number, first word).

    A document of fewer words is padded to a single window; one without words has none.
    """
    padded = [d if len(d) >= size else d + [int(_PAD)] * (size - len(d)) for d in docs if d]
    owner = np.array([i for i, d in enumerate(docs) if d], dtype=np.int64)
    if not padded:
        empty = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint64), empty, empty
    lens = np.array([len(d) for d in padded], dtype=np.int64)
    flat = np.concatenate([np.array(d, dtype=np.uint64) for d in padded])
    ends = np.cumsum(lens)
    begins = ends - lens
    count = lens - size + 1
    at = np.repeat(begins - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    with np.errstate(over="ignore"):
        value = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            value = (value ^ flat[at + j]) * _MULT
            value ^= value >> np.uint64(29)
    return value, np.repeat(owner, count), at - np.repeat(begins, count)


def band_values(docs: list[list[int]], size: int, bands: int, rows: int) -> tuple[list[list[int] | None], list[int]]:
    """One signed 64-bit value per band for each document, None for a document without words; and its number of distinct shingles."""
    value, owner, _ = window_hashes(docs, size)
    out: list[list[int] | None] = [None] * len(docs)
    if not len(value):
        return out, [0] * len(docs)
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    new = np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))
    sizes = np.bincount(o[new], minlength=len(docs)).tolist()
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    steps = np.random.default_rng(20240229).integers(1, 2**63, size=(bands * rows, 2), dtype=np.uint64)
    lows = []
    with np.errstate(over="ignore"):
        for a, b in steps:
            mixed = (value ^ b) * (a | np.uint64(1))
            lows.append(np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), first))
        signed = []
        for band in range(bands):
            h = np.full(len(first), np.uint64(band + 1), dtype=np.uint64)
            for low in lows[band * rows : (band + 1) * rows]:
                h = (h ^ low) * _MULT
                h ^= h >> np.uint64(32)
            signed.append(h.view(np.int64))
    table = np.stack(signed, axis=1).tolist()
    for doc, row in zip(owner[first].tolist(), table):
        out[doc] = row
    return out, sizes


def shingles(words: list[str], size: int) -> set[tuple[str, ...]]:
    """The set of ``size``-word shingles; a text of fewer words is one shingle."""
    return set(zip(*[words[i:] for i in range(size)])) if len(words) >= size else {tuple(words)}


def jaccard(one: set, two: set) -> float:
    both = len(one & two)
    return both / (len(one) + len(two) - both)
