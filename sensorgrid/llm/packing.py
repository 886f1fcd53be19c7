"""Documents packed into sequences of fixed length, shortest pack first over the length histogram.

A document is its ids and an end id, cut into pieces of ``length`` ids and a rest.  Pieces go to a
table without their ids (place, length and checksum; ``piece_ids`` gives the ids).  The histogram
has at most ``length`` rows; lengths are placed longest first, each time into the pack that is
shortest so far, for all packs of one pattern at once, so the work depends on the number of
patterns only.  Pieces of one length are numbered in hash buckets, so that a length with a third of
all pieces is no single sort, and their number picks pattern, sequence and offset.

There are at most two patterns for each length and 63 different lengths in a pattern of 2048, so
the pattern table that goes to every task is bounded whatever the number of documents.

Defined results: a null or empty text is the end id alone; rows with a null id and repeated rows
are packed like any other; an empty table gives no sequences.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches
from sensorgrid.llm.pretokens import PretokenCodes
from sensorgrid.llm.token_counts import RaggedMerger
from sensorgrid.session import stored

VOCABULARY = "byte_bpe_50k.json"
LENGTH, END_ID, BUCKETS = 2048, 1, 256
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def id_table(vocabulary: str) -> PretokenCodes:
    """Ids of texts as the tokenizer's own library gives them (tests compare the two)."""
    merger = RaggedMerger(vocabulary)
    return PretokenCodes(lambda words: merger.merged([w.encode() for w in words]), merger.special, merger.special_id)


def _cut(rows: DataFrame, vocabulary: str, length: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every row; the ids themselves only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = id_table(vocabulary)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            data: list[np.ndarray] = []
            codes, bounds = table.texts(batch.column(1).to_pylist())
            codes = np.insert(codes, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            for doc_id, first, last in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                for at in range(first, last, length):
                    piece = codes[at:min(at + length, last)]
                    for column, value in zip(out, (doc_id, at - first, len(piece), zlib.crc32(piece), last - first)):
                        column.append(value)
                    if with_ids:
                        data.append(piece)
            arrays = [pa.array(column, pa.int64()) for column in out]
            if with_ids:
                arrays.append(pa.array(data, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(arrays)])

    return map_batches(rows, run, _PIECE + (", ids array<bigint>" if with_ids else ""))


def piece_ids(docs: DataFrame, *, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with their ids: ``(doc_id, start, length, ids_crc32, doc_tokens, ids)``."""
    return _cut(id_and_text(docs, id_col, text_col), vocabulary, length, end_id, True)


def patterns(histogram: dict[int, int], length: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """``(number of packs, [(piece length, copies in a pack), ...])`` by shortest pack first, longest pieces first."""
    packs: list[tuple[int, int, int]] = []  # used, pattern number, count
    contents: list[tuple[tuple[int, int], ...]] = []

    def push(used: int, content: tuple[tuple[int, int], ...], count: int) -> None:
        contents.append(content)
        heapq.heappush(packs, (used, len(contents) - 1, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left and packs and packs[0][0] + size <= length:
            used, number, count = heapq.heappop(packs)
            # Packs of this pattern take one copy each; the last may find fewer pieces than packs.
            taken = min(left, count)
            content = contents[number]
            if content[-1][0] == size:
                grown = (*content[:-1], (size, content[-1][1] + 1))
            else:
                grown = (*content, (size, 1))
            push(used + size, grown, taken)
            if count > taken:
                heapq.heappush(packs, (used, number, count - taken))
            left -= taken
        fit = length // size
        if left >= fit:
            push(fit * size, ((size, fit),), left // fit)
        if left % fit:
            push(left % fit * size, ((size, left % fit),), 1)
    return [(count, list(contents[number])) for _, number, count in sorted(packs)]


def pattern_rows(packs: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each length and pattern: ranks from ``first`` on go to packs from ``sequence`` on at ``offset``."""
    taken: dict[int, int] = {}
    rows = []
    sequence = 0
    for count, content in packs:
        offset = 0
        for size, copies in content:
            rows.append((size, taken.get(size, 0), sequence, copies, offset))
            taken[size] = taken.get(size, 0) + count * copies
            offset += size * copies
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "sequence", "copies", "offset"), table.T))


def pack_documents(docs: DataFrame, *, vocabulary: str = VOCABULARY, length: int = LENGTH, end_id: int = END_ID,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    pieces = stored(_cut(id_and_text(docs, id_col, text_col), vocabulary, length, end_id, False), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = pattern_rows(patterns(histogram, length))

    bucketed = pieces.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, start), {BUCKETS})").cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = (
        bucketed.withColumn("number", F.row_number().over(inside)).join(shifts, ["length", "bucket"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("number") - 1 + F.col("shift")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table["size"] << 48) + table["first"]
        for batch in batches:
            size, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 5))
            row = np.searchsorted(keys, (size << 48) + rank, side="right") - 1
            number, copies = rank - table["first"][row], table["copies"][row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(table["sequence"][row] + number // copies),
                 pa.array(table["offset"][row] + number % copies * size)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return map_batches(ranked, place, _PIECE + ", sequence_id bigint, offset bigint")
