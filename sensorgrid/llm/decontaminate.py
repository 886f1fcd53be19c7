"""Benchmark passages in documents, found by one Aho-Corasick automaton over words.

Test questions and answers are normalised to words (A-Z lower-cased; a word is a run of digits, letters and
characters over U+007F) and every ``size`` consecutive words of an item are a window; an item with fewer words is one window.
The automaton holds the windows as sequences of word numbers and reads each document's words once, whatever the number of windows.
Words keep their place in the UTF-8 bytes, so what is found maps back to code points of the original text.

The items go to the executors as one broadcast while they have at most ``per_automaton`` windows, a bound that is
counted first.  Beyond it the windows are dealt to several automata, and documents go past one after the other; what was found travels
with the rows, so no row is matched by its id and the result is the same.

Defined results: a null text has no words, in documents and items alike.  Rows are never merged: repeated rows
and null ids are returned as they came.  Items that share an id count once.  An item without an id marks words but is neither counted nor
listed.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches
from sensorgrid.session import stored

#: Windows that one automaton holds at most; of ten words each they take some 150 MB in a worker.
PER_AUTOMATON = 200_000
#: Windows in a piece of an item; longer items are several pieces, so no row grows with the item.
PIECE = 1000

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode().translate(_FOLD).split()


def word_places(text: str) -> list[tuple[int, int]]:
    """First and end code point of each word of a text."""
    folded = np.frombuffer(text.encode().translate(_FOLD), np.uint8)
    inside = np.concatenate([[False], folded != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum(np.frombuffer(text.encode(), np.uint8) & 0xC0 != 0x80)])
    return list(zip(points[edges[::2]].tolist(), points[edges[1::2]].tolist()))


class WindowAutomaton:
    """Finds every occurrence of the windows of the items ``(name, words)``; ``name`` may be None."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int):
        self.numbers: dict[bytes, int] = {}
        names: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            for at in range(max(len(ids) - size + 1, 1) if ids else 0):
                names.setdefault(ids[at:at + size], set()).update([] if name is None else [name])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, found in names.items():
            self.automaton.add_word(window, (len(window), frozenset(found)))
        self.empty = not names
        if names:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged intervals ``(first word, end)`` that windows cover, and the names of their items."""
        if self.empty or not words:
            return [], set()
        number = self.numbers.get
        spans, items = [], set()
        for last, (length, names) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            spans.append((last + 1 - length, last + 1))
            items |= names
        return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of intervals, as rising intervals that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def item_pieces(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, words, windows)``: the words of every item in pieces of at most ``PIECE`` windows."""
    lone = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                windows = max(len(words) - size + 1, 1) if words else 0
                starts = range(0, windows, PIECE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(starts), pa.string()),
                     pa.array([b" ".join(words[at:at + PIECE + size - 1]).decode() for at in starts], pa.string()),
                     pa.array([min(PIECE, windows - at) for at in starts], pa.int64())], names=["item", "words", "windows"])

    return map_batches(lone.filter("text IS NOT NULL"), cut, "item string, words string, windows bigint").distinct()


FOUND = "doc_id bigint, text string, n_words bigint, firsts array<int>, ends array<int>, items array<string>"


def find_windows(docs: DataFrame, items: DataFrame, *, size: int = 10, per_automaton: int = PER_AUTOMATON, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_words, firsts, ends, items)`` for every document.

    ``firsts`` and ``ends`` are the word intervals that windows cover, ``items`` the names of the items with a window in the
    document, sorted as strings.
    """
    spark = docs.sparkSession
    pieces = stored(item_pieces(items, size, item_col, item_text_col), "benchmark-pieces")
    total = pieces.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    parts = max(-(-total // per_automaton), 1)
    found = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", F.lit(0).cast("bigint").alias("n_words"), *(F.array().cast("array<int>").alias(c) for c in ("firsts", "ends")),
        F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        # Bounded by ``per_automaton`` windows for each part: pieces are dealt by a hash.
        mine = pieces.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part) if parts > 1 else pieces
        shared = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in mine.select("item", "words").collect()])
        found = map_batches(found, _scanner(shared, size), FOUND)
        if part + 1 < parts:
            found = stored(found, "benchmark-found")
    return found


def _scanner(shared: Broadcast, size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WindowAutomaton([(item, words.encode().split(b" ")) for item, words in shared.value], size)
        for batch in batches:
            counts, firsts, ends, names = [], [], [], []
            before = zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))
            for text, (first, end, items) in zip(batch.column(1), before):
                words = words_of(text.as_py())
                spans, hits = automaton.scan(words)
                if spans and first:
                    spans = merged([*spans, *zip(first, end)])
                elif first:
                    spans = list(zip(first, end))
                counts.append(len(words))
                firsts.append([s for s, _ in spans])
                ends.append([e for _, e in spans])
                names.append(sorted(hits.union(items)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(firsts, pa.list_(pa.int32())),
                 pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "firsts", "ends", "items"])

    return scan


def contamination(found: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of the result of ``find_windows``."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x)
    hit = total("ends") - total("firsts")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def passages(found: DataFrame) -> DataFrame:
    """``(doc_id, start, end, passage)``: the covered passages as code points of the original text, end exclusive."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, firsts, ends in zip(*(batch.column(c).to_pylist() for c in range(4))):
                places = word_places(text)
                spans = [(places[a][0], places[b - 1][1]) for a, b in zip(firsts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id] * len(spans), pa.int64()), *(pa.array([s[k] for s in spans], pa.int64()) for k in (0, 1)),
                     pa.array([text[a:b] for a, b in spans], pa.string())], names=["doc_id", "start", "end", "passage"])

    hit = found.filter(F.size("firsts") > 0).select("doc_id", "text", "firsts", "ends")
    return map_batches(hit, place, "doc_id bigint, start bigint, end bigint, passage string")
