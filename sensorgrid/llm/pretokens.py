"""Pre-tokens of many texts at once, and what they encode to.

The public byte-level pattern is followed on code points in numpy: the texts of a batch lie in one
array, a table gives the class of each code point, and boundaries are where the class changes,
moved by the pattern's rules for spaces and for contractions.  Different pre-tokens are told
apart by a 64-bit hash (a wrong match among a million has a chance of 3e-8), so that a
pre-token is cut out as a string and encoded only when a task meets it for the first time.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from sensorgrid.llm.words import BASE, BASE_INVERSE, mixed

#: Pre-tokens whose encoding a task keeps; beyond it starts again with none.
KEPT = 600_000
#: Code points worked on at once; a longer text widens its own group.
GROUP = 1 << 20

SPACE, LETTER, NUMBER, OTHER, END = range(5)
#: What follows an apostrophe in the pattern's contractions.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


class ClassTable:
    """Class of each code point, filled by pages of 256 when they are first met."""

    def __init__(self):
        self.table = np.zeros(0x110000, np.uint8)
        self.filled = np.zeros(0x1100, bool)

    def classes(self, points: np.ndarray) -> np.ndarray:
        pages = np.flatnonzero(np.bincount(points >> 8, minlength=1))
        for page in pages[~self.filled[pages]].tolist():
            for point in range(page << 8, (page + 1) << 8):
                self.table[point] = self._of(chr(point))
            self.filled[page] = True
        return self.table[points]

    @staticmethod
    def _of(char: str) -> int:
        kind = unicodedata.category(char)[0]
        if kind in "LN":
            return LETTER if kind == "L" else NUMBER
        # isspace also holds for four separators that are not white space in the pattern.
        return SPACE if char.isspace() and not "\x1c" <= char <= "\x1f" else OTHER


def starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of ``points`` start; each text is followed by one point of class END."""
    n = len(points)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kind[1:], END
    # The last white space before something else is cut off; a plain space then belongs to what follows.
    last = np.flatnonzero((kind == SPACE) & (after != SPACE) & (after != END))
    start[last] = True
    spaces = last[points[last] == 0x20]
    start[spaces + 1] = False
    # Contractions begin with an apostrophe that is a pre-token's first point and stands alone.
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[start[marks] & (after[marks] == LETTER)]
    if len(marks):
        padded = np.append(points, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(marks), bool)
        for ending in LONG_ENDINGS:
            long |= (one == ord(ending[0])) & (two == ord(ending[1]))
        for found, size in ((marks[short], 2), (marks[long & ~short], 3)):
            start[found + 1] = False
            stop = found + size
            start[stop[kind[stop] == LETTER]] = True
    return start


class PretokenCodes:
    """Encodings of the pre-tokens of texts as one ragged array.

    ``encode`` takes different pre-tokens and returns the length of each encoding and the codes
    behind one another.  ``special`` is a string that the tokenizer takes as one token wherever
    it stands, with the code ``special_code``.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], special: str | None = None,
                 special_code: int = 0):
        self.encode, self.special, self.special_code, self.table = encode, special, special_code, ClassTable()
        self.powers = self.inverses = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        # Slot 0 is the special string, slot 1 is nothing.
        self.lengths, self.offsets = np.array([1, 0]), np.array([0, 1])
        self.codes = np.array([self.special_code], np.int64)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts behind one another, and the n + 1 bounds of the texts in them."""
        parts, at = [], 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= GROUP):
                size += len(texts[end])
                end += 1
            parts.append(self._group(texts[at:end]))
            at = end
        if not parts:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
        return np.concatenate([codes for codes, _ in parts]), np.append(0, np.cumsum(sizes))

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, owner, special = texts, np.arange(len(texts)), np.zeros(len(texts), bool)
        if self.special and any(self.special in t for t in texts):
            cut = [t.split(self.special) for t in texts]
            pieces = [p for ps in cut for p in ps]
            owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in cut])
            special = np.append(owner[1:] == owner[:-1], False)
        slots, piece = self._slots(pieces)
        # A piece that is followed by the special string ends with slot 0, any other with slot 1.
        ends = np.where(special, 0, 1)
        order = np.argsort(np.concatenate([piece, np.arange(len(pieces))]), kind="stable")
        slots, piece = np.concatenate([slots, ends])[order], np.concatenate([piece, np.arange(len(pieces))])[order]
        sizes = self.lengths[slots]
        total = np.cumsum(sizes)
        index = np.repeat(self.offsets[slots] - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)
        bounds = np.append(0, np.cumsum(np.bincount(owner[piece], weights=sizes, minlength=len(texts)).astype(np.int64)))
        return self.codes[index], bounds

    def _slots(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot and piece number of every pre-token."""
        whole = "\n".join(pieces) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        kind = self.table.classes(points)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        kind[ends] = END
        start = starts(points, kind)
        start[ends] = True
        begin = np.flatnonzero(start)
        if len(self.powers) < n:
            for name, base in (("powers", BASE), ("inverses", BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(points.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        stop = np.append(begin[1:], n)
        inner = kind[begin] != END
        begin, stop = begin[inner], stop[inner]
        hashes = mixed((sums[stop] - sums[begin]) * self.inverses[begin] + (stop - begin).astype(np.uint64))
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > KEPT:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
        new = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if new.any():
            words = [whole[a:b] for a, b in zip(begin[first[new]].tolist(), stop[first[new]].tolist())]
            lengths, codes = self.encode(words)
            place = len(self.lengths) + np.arange(len(words))
            self.offsets = np.concatenate([self.offsets, len(self.codes) + np.cumsum(lengths) - lengths])
            self.lengths, self.codes = np.concatenate([self.lengths, lengths]), np.concatenate([self.codes, codes])
            hashes = np.concatenate([self.hashes, distinct[new]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.places = hashes[order], np.concatenate([self.places, place])[order]
        slot = self.places[np.searchsorted(self.hashes, distinct)] if len(distinct) else np.zeros(0, np.int64)
        return slot[back], np.searchsorted(ends, begin)
