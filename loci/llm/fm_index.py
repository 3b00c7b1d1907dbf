"""A compressed full-text index over word sequences: suffix order, Burrows-Wheeler transform, wavelet matrix.

Symbols are small integers; 0 ends a segment.  The transform is held as bit planes of
packed 64-bit words with running counts, one plane per bit of the alphabet, so it takes
about (1 + 1/2) * log2(alphabet) bits a symbol.  All searches run on many patterns at
once as numpy steps.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; each 0 differs from every other, in text order."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    new = np.ones(n, bool)
    new[1:] = rank[order[1:]] != rank[order[:-1]]
    rank[order] = np.cumsum(new) - 1
    reach = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        ranked = key[order]
        new[1:] = ranked[1:] != ranked[:-1]
        rank[order] = np.cumsum(new) - 1
        reach *= 2
    return order


class BitPlane:
    """Packed bits with running counts: how many ones stand before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1])]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class FMIndex:
    """Counts occurrences of patterns by backward search."""

    def __init__(self, text: np.ndarray):
        """``text``: symbols, each segment ended by a 0."""
        self.size = len(text)
        alphabet = int(text.max()) + 1 if len(text) else 1
        order = suffix_order(text)
        transform = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.levels = max(1, (alphabet - 1).bit_length())
        self.planes, self.zeros = [], []
        symbols = transform
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level) & 1
            self.planes.append(BitPlane(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.base = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, plane in enumerate(self.planes):
            ones = plane.ones(at)
            bit = (symbols >> (self.levels - 1 - i)) & 1
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after putting one symbol before each pattern."""
        both = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.first[symbols] - self.base[symbols]
        return start + both[: len(low)], start + both[len(low) :]


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which windows of streamed segments occur twice or more in the index.

    ``text`` holds the segments; segment i has ``windows[i]`` windows of ``length``
    symbols, the first at ``starts[i]``.  Backward search from the end of a window
    gives the matching statistic there: the longest stretch ending at it that occurs
    at least twice.  A stretch of ``length`` or more settles all windows inside it; a
    shorter one rules out all windows that hold the symbol where it stopped.  Each segment is
    worked from its right end and, where that fails, from its left end.  All segments
    go in step.  Returns one flag per window, segment after segment.
    """
    first = np.concatenate([[0], np.cumsum(windows)])
    found = np.zeros(first[-1] + 1, np.int32)  # +1 where a run of repeated windows begins, -1 after it
    lane = np.flatnonzero(windows > 0)
    left, right = np.zeros(len(lane), np.int64), windows[lane] - 1  # windows still open
    from_right = np.ones(len(lane), bool)
    end = right + length - 1
    at = end.copy()
    low, high = np.zeros(len(lane), np.int64), np.full(len(lane), index.size, np.int64)
    while len(lane):
        symbols = text[starts[lane] + at]
        new_low, new_high = index.extend(symbols, low, high)
        holds = new_high - new_low >= 2
        # Going left ends at the segment's beginning, or at the last open window for a search from the left.
        stop = np.where(from_right, left, end - length + 1)
        done = ~holds | (at == stop)
        begin = np.where(holds, at, at + 1)  # the stretch is [begin, end]
        low, high = new_low, new_high
        at = at - 1
        if not done.any():
            continue
        d = np.flatnonzero(done)
        far, b, e, r = begin[d], left[d], end[d], from_right[d]
        hit = e - far + 1 >= length
        # From the right: a hit settles windows far..right, and the one before far is ruled out too unless the search ran out.
        run_from, run_to = np.maximum(far, b), e - length + 1
        where = first[lane[d]]
        np.add.at(found, (where + run_from)[hit], 1)
        np.add.at(found, (where + run_to + 1)[hit], -1)
        failed_at = far - 1
        new_left = np.where(~r, np.where(hit, e - length + 2, failed_at + 1), b)
        new_right = np.where(r, np.where(hit, far - 1, right[d] - 1), right[d])
        left[d], right[d] = new_left, new_right
        # After a miss from the right look from the left next; after a hit or a look from the left start from the right again.
        from_right[d] = ~r | hit
        end[d] = np.where(from_right[d], new_right, new_left) + length - 1
        at[d] = end[d]
        low[d], high[d] = 0, index.size
        keep = left <= right
        if not keep.all():
            lane, left, right, from_right, end, at, low, high = (x[keep] for x in (lane, left, right, from_right, end, at, low, high))
    return np.cumsum(found[:-1]) > 0
