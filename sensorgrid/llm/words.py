"""64-bit hashes of the words of many texts at once, on the bytes of an Arrow column.

A word's hash is a polynomial in an odd base over a random 64-bit value for each byte, taken from
running sums, and mixed at the end.  It depends on the word's bytes alone.
"""

from __future__ import annotations

import numpy as np

#: Bytes worked on at once; a longer word widens its own piece.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)

WHITE, LETTER, DIGIT, MARK = 0, 1, 2, 3


def byte_classes(*, separate_marks: bool) -> np.ndarray:
    """Class of each byte: white space, letters (every byte over 0x7F too), digits, marks.

    Without ``separate_marks`` all but white space is one class.
    """
    classes = np.full(256, MARK if separate_marks else LETTER, np.uint8)
    if separate_marks:
        classes[ord("A"):ord("Z") + 1] = classes[ord("a"):ord("z") + 1] = classes[0x80:] = LETTER
        classes[ord("0"):ord("9") + 1] = DIGIT
    classes[[0x20, *range(0x09, 0x0E)]] = WHITE
    return classes


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit of the input moves every bit of the result."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Finds the runs of one byte class and hashes them.

    ``lower`` folds A-Z first.  ``prefix`` also hashes the first so many bytes of words longer
    than that; other words get 0 there.
    """

    def __init__(self, *, separate_marks: bool = False, lower: bool = True, prefix: int = 0):
        self.classes, self.lower, self.prefix = byte_classes(separate_marks=separate_marks), lower, prefix
        self.fold = lower_table()
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(hash, class, text number[, prefix hash])`` of all words in order."""
        found, at, n = [], 0, len(data)
        while at < n:
            end = min(n, at + PIECE)
            if end < n:
                end = self._cut(data, offsets, at, end)
            found.append(self._piece(data[at:end], offsets, at))
            at = end
        if not found:
            empty = np.zeros(0, np.uint64)
            return (empty, np.zeros(0, np.uint8), np.zeros(0, np.int64)) + ((empty,) if self.prefix else ())
        return tuple(np.concatenate(x) for x in zip(*found))

    def _cut(self, data: np.ndarray, offsets: np.ndarray, at: int, end: int) -> int:
        """The last place up to ``end`` between two words, or the first one after it."""
        for lo, hi, last in ((at, end, True), (end, len(data), False)):
            while lo < hi:
                a, b = (max(lo, hi - 4096), hi) if last else (lo, min(hi, lo + (1 << 16)))
                gaps = np.flatnonzero(self.classes[data[a:b]] == WHITE)
                if len(gaps):
                    place = a + int(gaps[-1 if last else 0]) + (1 if last else 0)
                    if place > at:
                        return place
                lo, hi = (lo, a) if last else (b, hi)
            starts = offsets[(offsets > at) & (offsets <= end)] if last else offsets[offsets > end]
            if len(starts):
                return int(starts[-1] if last else starts[0])
        return len(data)

    def _piece(self, data: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(data)
        self._grow(n + 1)
        kind = self.classes[data]
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
        first, last = np.searchsorted(offsets, [at, at + n])
        edge[offsets[first:last] - at] = True
        cuts = np.flatnonzero(edge)
        keep = kind[cuts[:-1]] != WHITE
        start, end = cuts[:-1][keep], cuts[1:][keep]
        sums = np.zeros(n + 1, np.uint64)
        values = self.values[self.fold] if self.lower else self.values
        np.cumsum(values[data] * self.powers[:n], out=sums[1:])
        text = np.searchsorted(offsets, start + at, side="right") - 1
        out = (mixed((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64)), kind[start], text)
        if self.prefix:
            stop = np.minimum(start + self.prefix, n)
            short = mixed((sums[stop] - sums[start]) * self.inverses[start] + np.uint64(0xA5A5))
            out += (np.where(end - start > self.prefix, short, np.uint64(0)),)
        return out
