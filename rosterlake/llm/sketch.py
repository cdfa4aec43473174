"""Shingle sets and fast similarity sketches, for many texts at a time.

Fast similarity sketching: in round i each element is hashed to one of `size` bins and to a value; a bin keeps the
least value of the first round that filled it, so later rounds only fill bins that are still empty. From round `size`
on, round i offers every element to bin i - size, so after 2 * size rounds no bin is empty. Coordinates of two sets
agree with the probability of their Jaccard similarity, with concentration as for independent samples, at the cost of
about one pass over a set of some size.
"""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all of them rather than grow beyond `most`."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_sets(texts: list[bytes | None], n: int, hashes: WordHashes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles, or of all its words where they are fewer."""
    rows = [t.lower().split() if t else [] for t in texts]
    ends = np.cumsum([len(r) for r in rows])
    h = np.fromiter((hashes[w] for r in rows for w in r), dtype=np.uint64, count=int(ends[-1]) if len(ends) else 0)

    def joined(x: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(x) - k + 1), _A ^ np.uint64(k))
        for j in range(k):
            out = mixed(out * _A + x[j : j + len(out)])
        return out

    every, sets, at = joined(h, n), [], 0
    for end in ends.tolist():
        size = end - at
        sets.append(np.unique(every[at : end - n + 1] if size >= n else joined(h[at:end], size)) if size else h[:0])
        at = end
    return sets


def fast_sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of `size` 64-bit coordinates for each non-empty set."""
    if not sets:
        return np.zeros((0, size), dtype=np.uint64)
    best = np.full(len(sets) * size, _FULL)
    elements = np.concatenate(sets)
    base = np.repeat(np.arange(len(sets)) * size, [len(s) for s in sets])
    for i in range(2 * size):
        h = mixed(elements ^ mixed(np.full(1, i + 1, dtype=np.uint64)))
        bins = base + ((h >> np.uint64(33)) % np.uint64(size)).astype(np.int64) if i < size else base + (i - size)
        value = mixed(h * _A)
        value[value == _FULL] = 0
        if i:
            still = empty[bins]
            bins, value = bins[still], value[still]
        np.minimum.at(best, bins, value)
        empty = best == _FULL
        lacking = empty.reshape(-1, size).any(1)
        if not lacking.any():
            break
        keep = lacking[base // size]
        elements, base = elements[keep], base[keep]
    return best.reshape(-1, size)


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """For each sketch a 64-bit key for each band of `rows` coordinates; keys of different bands differ."""
    table = sketches.reshape(len(sketches), sketches.shape[1] // rows, rows)
    key = np.broadcast_to(mixed(np.arange(1, table.shape[1] + 1, dtype=np.uint64) * _C), table.shape[:2])
    for j in range(rows):
        key = mixed(key * _A + table[:, :, j])
    return key
