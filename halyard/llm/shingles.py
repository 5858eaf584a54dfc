"""Word shingles of whole texts as 64-bit hashes, computed over a batch at a time."""

from __future__ import annotations

import numpy as np

from .common import mix, take_ranges

_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the words' offsets by text.

    Words are read eight bytes at a time; up to eight bytes the hash is one to one for a length.
    """
    n = len(data)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _LOWER[data]
    solid = ~_GAP[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    before[at[:-1][at[:-1] < n]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    lengths = np.flatnonzero(solid & ~after) + 1 - starts
    load = np.ndarray((n + 1,), "<u8", padded, strides=(1,))
    h = mix(lengths.astype(np.uint64) * _ODD)
    active, offset = np.arange(len(starts)), 0
    while len(active):
        left = lengths[active] - offset
        part = load[starts[active] + offset] & _KEEP[np.minimum(left, 8)]
        h[active] = mix((h[active] ^ part) * _ODD)
        active, offset = active[left > 8], offset + 8
    return h, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words has one shingle, the whole sequence; one without words has none.
    """
    words, of = word_hashes(data, at)
    counts = np.diff(of)
    chain = words.copy()
    for j in range(1, k):
        chain[: len(words) - j] = mix(chain[: len(words) - j] * _ODD + words[j:])
    sizes = np.maximum(0, counts - k + 1)
    flat = chain[take_ranges(of[:-1], sizes)]
    ends = np.cumsum(sizes)
    out = [np.unique(flat[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    for d in np.flatnonzero((counts > 0) & (counts < k)):
        h = np.array([counts[d]], np.uint64)
        for w in words[of[d] : of[d + 1]]:
            h = mix(h * _ODD + w)
        out[d] = h
    return out
