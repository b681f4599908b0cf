"""A run-length Burrows-Wheeler index of the windows of one bucket of text pieces, and matching statistics streamed over it.

The text is a sequence of symbols: bytes plus one, and 0 where a piece ends. Rows are its windows, the strings of ``span`` symbols inside a piece,
in the order of their symbols, equal ones in that of the text. The transform has, for each row, the symbol before its window. Going one symbol back
(the LF step) maps rows that follow each other and have that symbol in common to rows that follow each other, except where the last window of
some piece, which is no window's predecessor, comes between. So the transform is kept as runs of rows with one symbol and one shift: the start,
the length, where it leads, and the text place of its last row (the sampled run ends). Of equal windows, and of windows that agree in all but
their last symbol, the ends of the groups of rows are kept, of the latter with their places. Neither the rows nor their places are.
"""

from __future__ import annotations

import numpy as np


def pieces_text(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the pieces, each ended by 0, with their starts and lengths."""
    length = np.array([len(p) for p in pieces], np.int64)
    start = np.cumsum(length + 1) - length - 1
    symbols = np.zeros(int((length + 1).sum()), np.uint16)
    inside = np.ones(len(symbols), bool)
    inside[start + length] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint16) + 1
    return symbols, start, length


def expanded(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... of counts[i] each."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _ordered(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of keys of so many bits, and their dense ranks. Sorting values is much faster than sorting places, so keys carry theirs if they can."""
    width = len(key).bit_length()
    if bits + width <= 63:
        both = np.sort((key << width) | np.arange(len(key)))
        order, held = both & ((1 << width) - 1), both >> width
    else:
        order = np.argsort(key, kind="stable")
        held = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.r_[False, held[1:] != held[:-1]][: len(key)])
    return order, rank


def _ends(group: np.ndarray) -> np.ndarray:
    """Ends of the runs of equal values."""
    return np.r_[np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)]


class RunIndex:
    def __init__(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, span: int):
        if span < 2:
            raise ValueError("span must be 2 at least")
        n, self.span = len(symbols), span
        width = n.bit_length()
        self.windows = np.maximum(length - span + 1, 0)
        self.first = np.cumsum(self.windows) - self.windows
        at = expanded(start, self.windows)
        self.size = len(at)
        # Dense ranks of all places by some symbols, doubled to a fifth of the span or so.
        used = np.flatnonzero(np.bincount(symbols, minlength=257))
        dense = np.zeros(257, np.int64)
        dense[used] = np.arange(len(used))
        bits = max(1, len(used).bit_length())
        depth = max(1, min((63 - width) // bits, span - 1))
        wide = np.zeros(n + depth, np.int64)
        wide[:n] = dense[symbols]
        key = wide[:n].copy()
        for i in range(1, depth):
            key = (key << bits) | wide[i : i + n]
        rank = _ordered(key, bits * depth)[1]
        while depth * 5 < span:
            after = np.zeros(n, np.int64)
            after[: n - depth] = rank[depth:] + 1
            rank, depth = _ordered((rank << width) | after, 2 * width)[1], depth * 2
        # Windows by all but their last symbol, then by that.
        most = rank[at]
        for offset in [*range(depth, span - 1 - depth, depth), *([span - 1 - depth] if span - 1 > depth else [])]:
            most = _ordered((most << width) | rank[at + offset], 2 * width)[1]
        order, own = _ordered((most << 9) | symbols[at + span - 1], width + 9)
        place = at[order]
        self.group_end, self.wide_end = _ends(own[order]), _ends(most[order])
        self.wide_place = place[self.wide_end - 1]
        row = np.empty(self.size, np.int64)
        row[order] = np.arange(self.size)
        before = np.where(place > 0, symbols[place - 1], 0)
        leads = np.where(before > 0, row[order - 1], -1)
        run = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | ((leads[1:] != leads[:-1] + 1) & (before[1:] > 0))][: self.size])
        long = np.diff(np.r_[run, self.size])
        by = np.argsort(before[run], kind="stable")
        self.width, self.key = width, (before[run][by].astype(np.int64) << width) | run[by]
        self.start, self.length, self.leads, self.sample = run[by], long[by], leads[run][by], place[run + long - 1][by]
        self.tail = row[np.maximum(self.first + self.windows - 1, 0)] if self.size else self.first  # of each piece's last window
        self.text, self.begin = symbols, start
        raw = np.zeros(n + 8, np.uint8)
        raw[:n] = np.maximum(symbols, 1) - 1
        self.eights = np.ndarray((n + 1,), "<u8", raw.tobytes(), strides=(1,))

    def step(self, row: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows in the rows: a row and a place of the window that has one symbol more in front and one less at the end. All rows that
        agree in the symbols that stay are asked for the last one with that symbol before it, by the runs; its place is a sampled one."""
        group = np.searchsorted(self.wide_end, row, "right")
        end = self.wide_end[group]
        run = np.searchsorted(self.key, (symbol.astype(np.int64) << self.width) | end) - 1
        into = np.minimum(end - self.start[run], self.length[run]) - 1
        place = np.where(self.start[run] + into == end - 1, self.wide_place[group], self.sample[run])
        return self.leads[run] + into, place - 1

    def agree(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether the text has the same span symbols at places a and b, both of windows."""
        if self.span < 8:
            return all((self.text[a + i] == self.text[b + i]).all() for i in range(self.span))
        return all((self.eights[a + i] == self.eights[b + i]).all() for i in [*range(0, self.span - 8, 8), self.span - 8])

    def statistics(self):
        """Streams all pieces at once, each from its last window back. Yields for the matches of a whole window the piece, the offset in it and the end of
        the match's rows, which equal windows share. Pieces are in the index, so every window matches; a step only says with which rows."""
        piece = np.flatnonzero(self.windows)
        row, offset = self.tail[piece], self.windows[piece] - 1
        while len(piece):
            yield piece, offset, self.group_end[np.searchsorted(self.group_end, row, "right")]
            live = offset > 0
            piece, row, offset = piece[live], row[live], offset[live] - 1
            at = self.begin[piece] + offset
            # In the order of symbol, then row, lookups run through the runs once.
            by = np.sort((((self.text[at].astype(np.int64) << self.width) | row) << self.width) | np.arange(len(at))) & ((1 << self.width) - 1)
            piece, row, offset, at = piece[by], row[by], offset[by], at[by]
            row, place = self.step(row, self.text[at])
            if not self.agree(at, place):
                raise RuntimeError("the index named a place that differs from its match")
