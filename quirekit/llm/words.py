"""Vectorised word hashing: 64-bit hashes of all whitespace-separated words of an Arrow batch of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RATIO, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes hashed at a time.
_PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they were asked for."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, _PIECE + 1)
            cls.up = np.multiply.accumulate(np.r_[_U(1), np.full(n, _RATIO, _U)])
            cls.down = np.multiply.accumulate(np.r_[_U(1), np.full(n, _INVERSE, _U)])
        return cls.up, cls.down


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 word offsets of the rows."""
    solid = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = True
        np.logical_not(solid[:-1], out=before[1:])
        before |= cut[:-1]
    starts = np.flatnonzero(solid & before)
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = True
        np.logical_not(solid[1:], out=after[:-1])
        after |= cut[1:]
    ends = np.flatnonzero(solid & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words; ``lower`` folds A-Z only."""
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        base = starts[i]
        piece = raw[base : ends[j - 1]]
        up, down = _Powers.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, _U)
        np.cumsum(table[piece] * up[: len(piece)], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
        i = j
    return out


def sliced(batch, limit: int = 4 << 20):
    """Zero-copy slices of a record batch with at most ``limit`` bytes of text each, or one row."""
    _, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def hashed(batch, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a batch's ``text`` and the n+1 offsets of its rows."""
    raw, offs = text_bytes(batch.column(batch.schema.get_field_index("text")))
    starts, ends, rows = word_bounds(raw, offs)
    return word_hashes(raw, starts, ends, lower), rows


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words of one flat array (runs may cross rows: the caller masks them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    for i in range(k):
        out *= _U(0xC2B2AE3D27D4EB4F)
        out += words[i : i + n]
    return mix(out)
