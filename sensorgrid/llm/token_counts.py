"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie one behind the other in one array of symbols.  In each round every
sequence takes its own pair of lowest rank, and all of its occurrences are merged at once, in all
sequences together; a sequence without a known pair is done and leaves.  What survives is counted.
The tokenizer's file gives merges and vocabulary, no tokenizer code runs.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows with a null id and repeated
rows are counted like any other.  Surrounding columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import id_and_text, map_batches
from sensorgrid.llm.pretokens import PretokenCodes

VOCABULARY = "byte_bpe_50k.json"
#: Bytes merged at once.
SYMBOLS = 1 << 19
NONE = np.int64(1 << 40)
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others, in order, take the code points from 256.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class RaggedMerger:
    """Merge tables of a byte-level vocabulary as sorted arrays."""

    def __init__(self, file: str = VOCABULARY):
        with open(public_tokenizers.path(file), encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary = spec["model"]["vocab"]
        special = next((t for t in spec["added_tokens"] if t["special"]), {"content": None, "id": 0})
        self.special, self.special_id = special["content"], special["id"]
        self.first = np.zeros(256, np.int64)
        for byte, letter in byte_letters().items():
            self.first[byte] = vocabulary[letter]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in merges], np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        # Open addressing: a pair lies in the first free slot from its hash on.
        self.pairs = np.full(SLOTS, -1, np.int64)
        self.ranks, self.made = np.full(SLOTS, NONE), np.zeros(SLOTS, np.int64)
        for rank, (pair, slot) in enumerate(zip(pairs.tolist(), self._slots(pairs).tolist())):
            while self.pairs[slot] >= 0:
                slot = (slot + 1) % SLOTS
            self.pairs[slot], self.ranks[slot], self.made[slot] = pair, rank, made[rank]

    @staticmethod
    def _slots(pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, pairs: np.ndarray) -> np.ndarray:
        """Slot of each pair, or an empty one."""
        slots = self._slots(pairs)
        met = self.pairs[slots]
        open_ones = np.flatnonzero((met != pairs) & (met >= 0))
        while len(open_ones):
            slots[open_ones] = (slots[open_ones] + 1) % SLOTS
            met = self.pairs[slots[open_ones]]
            open_ones = open_ones[(met != pairs[open_ones]) & (met >= 0)]
        return slots

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many symbols are left of each byte string, and the symbols behind one another."""
        sizes, symbols, at = [], [], 0
        while at < len(words):
            size, end = 0, at
            while end < len(words) and (size == 0 or size + len(words[end]) <= SYMBOLS):
                size += len(words[end])
                end += 1
            left = self._merge(words[at:end])
            sizes.append(left[0])
            symbols.append(left[1])
            at = end
        if not sizes:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(sizes), np.concatenate(symbols)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            keys = (symbols[:-1] << 20) | symbols[1:]
            slot, inner = self._find(keys), owner[:-1] == owner[1:]
            rank = np.where(inner, self.ranks[slot], NONE)
            starts = np.append(0, np.flatnonzero(~inner) + 1)
            lowest = np.minimum.reduceat(np.append(rank, NONE), starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            alive = np.repeat(lowest < NONE, sizes)
            done.append((owner[~alive], symbols[~alive]))
            places = np.flatnonzero((rank == np.repeat(lowest, sizes)[:-1]) & (rank < NONE))
            if len(places):
                # Of pairs that overlap (a run of one symbol) every second one is merged, from the left.
                fresh = np.append(True, np.diff(places) != 1)
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - run) % 2 == 0]
                symbols[places] = self.made[slot[places]]
                alive[places + 1] = False
            symbols, owner = symbols[alive], owner[alive]
        owner, symbols = (np.concatenate(x) for x in zip(*done))
        return np.bincount(owner, minlength=len(words)), symbols[np.argsort(owner, kind="stable")]


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY, limit: int = 512, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = RaggedMerger(vocabulary)
        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            # What a pre-token leaves is kept as one code, its count.
            return np.ones(len(words), np.int64), merger.merged([w.encode() for w in words])[0]

        table = PretokenCodes(encode, merger.special, 1)
        for batch in batches:
            left, bounds = table.texts(batch.column(1).to_pylist())
            totals = np.diff(np.append(0, np.cumsum(left))[bounds])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals.astype(np.int64)), batch.column(2)],
                                             names=["doc_id", "n_tokens", "n_bytes"])

    rows = id_and_text(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    out = map_batches(rows, count, "doc_id bigint, n_tokens bigint, n_bytes bigint")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
