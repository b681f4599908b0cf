"""Distinct shingle sets of a batch of texts."""

from __future__ import annotations

import numpy as np

from .words import gram_hashes, hashed, mix

_U = np.uint64


def shingle_sets(batch, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, flat, and the n+1 offsets of the rows.

    A row of fewer than k words has its whole sequence as one shingle; one without words has none."""
    words, rows = hashed(batch, True)
    count = rows[1:] - rows[:-1]
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    offs = np.r_[0, np.cumsum(n)]
    out = np.empty(offs[-1], _U)
    grams = gram_hashes(words, k)
    for i in np.flatnonzero(n).tolist():
        a, b = offs[i], offs[i + 1]
        if count[i] >= k:
            own = grams[rows[i] : rows[i] + n[i]]
        else:
            own = mix(gram_hashes(words[rows[i] : rows[i + 1]], int(count[i])) + _U(count[i]))
        out[a:b] = own
        out[a:b].sort()
    first = np.ones(len(out), bool)
    first[1:] = out[1:] != out[:-1]
    first[offs[:-1][n > 0]] = True
    total = np.r_[0, np.cumsum(first)]
    return out[first], total[offs]


def signatures(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each row's set; 0 only for the empty set, in effect."""
    out = np.zeros(len(offs) - 1, _U)
    full = np.flatnonzero(offs[1:] > offs[:-1])
    if len(full):
        out[full] = mix(np.add.reduceat(mix(sets ^ _U(0x5851F42D4C957F2D)), offs[full]) + (offs[full + 1] - offs[full]).astype(_U))
    return out
