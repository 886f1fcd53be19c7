"""Byte-level BPE encoding and decoding by replaying merges over a corpus of words.

Each task gathers the different pre-tokens of the texts it reads and merges them as one corpus: an
inverted index leads from the rank of a mergeable pair to the positions of that pair in all
words; ranks are taken in order, each is applied at all its positions, and only the pairs
with the two neighbours of a merged position are looked up anew.  Two symbols may merge if their
bytes together are a token, at that token's rank; a new pair of lower rank than the current one is
replayed before the rest of its word.

Defined results: a null or empty text gives no ids; a null id column value is kept; repeated rows are
returned each.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorgrid.llm.common import id_and_text, map_batches
from sensorgrid.llm.pretokens import PretokenCodes

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of the words that are replayed together.
CORPUS_BYTES = 1 << 20
#: Pairs of symbols whose rank is remembered.
PAIRS = 500_000


def load_ranks(file: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(file), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, f))}


class MergeReplay:
    def __init__(self, file: str = RANKS):
        self.ranks = load_ranks(file)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}

    def look_up(self, pair: int) -> int:
        """Rank of the token that a pair of symbols makes, -1 if they make none; the pair is remembered."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        rank = self.pairs[pair] = self.ranks.get(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF], -1)
        return rank

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word."""
        out: list[tuple[int, ...]] = []
        group: list[bytes] = []
        size = 0
        for word in words:
            group.append(word)
            size += len(word)
            if size >= CORPUS_BYTES:
                out += self._replay(group)
                group, size = [], 0
        return out + self._replay(group)

    def _replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        done = {w: (self.ranks[w],) for w in words if w in self.ranks}
        open_words = [w for w in words if w not in done]
        # A gap of one position, symbol -1, parts the words; positions keep their number to the end.
        symbols: list[int] = [-1]
        starts = []
        for word in open_words:
            starts.append(len(symbols))
            symbols += map(self.single.__getitem__, word)
            symbols.append(-1)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, look_up = self.pairs.get, self.look_up
        index = self._first_index(np.array(symbols))
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            now = heapq.heappop(queue)
            places = index.pop(now, None)
            if places is None:
                continue
            places.sort()
            waiting_to = -1
            for at in places:
                a = symbols[at]
                if a < 0:
                    continue
                right = after[at]
                b = symbols[right]
                if b < 0 or known(a << 20 | b, -1) != now and look_up(a << 20 | b) != now:
                    continue
                if at < waiting_to:
                    self._add(index, queue, now, at)
                    continue
                symbols[at], symbols[right] = now, -1
                far = after[at] = after[right]
                before[far] = at
                left = before[at]
                a = symbols[left]
                if a >= 0:
                    rank = known(a << 20 | now)
                    if rank is None:
                        rank = look_up(a << 20 | now)
                    if rank >= 0:
                        self._add(index, queue, rank, left)
                        if rank < now:
                            waiting_to = starts[bisect_right(starts, at)] if at < starts[-1] else n
                b = symbols[far]
                if b >= 0:
                    rank = known(now << 20 | b)
                    if rank is None:
                        rank = look_up(now << 20 | b)
                    if rank >= 0:
                        self._add(index, queue, rank, at)
                        if rank < now:
                            waiting_to = starts[bisect_right(starts, at)] if at < starts[-1] else n
        for start, word in zip(starts, open_words):
            done[word] = tuple([s for s in symbols[start:start + len(word)] if s >= 0])
        return [done[w] for w in words]

    def _first_index(self, symbols: np.ndarray) -> dict[int, list[int]]:
        """Positions of the mergeable pairs of the single bytes, by rank."""
        pairs = symbols[:-1] << 20 | symbols[1:]
        distinct, back = np.unique(np.where((symbols[:-1] < 0) | (symbols[1:] < 0), -1, pairs), return_inverse=True)
        ranks = np.array([-1 if p < 0 else self.look_up(p) for p in distinct.tolist()], np.int64)[back]
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        cuts = np.flatnonzero(np.diff(ranks[order])) + 1
        return {int(ranks[part[0]]): part.tolist() for part in np.split(order, cuts) if len(part)}

    @staticmethod
    def _add(index: dict[int, list[int]], queue: list[int], rank: int, at: int) -> None:
        places = index.get(rank)
        if places is None:
            index[rank] = [at]
            heapq.heappush(queue, rank)
        else:
            places.append(at)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def text_encoder(replay: MergeReplay) -> PretokenCodes:
    """Ids of texts, each pre-token merged for itself."""

    def words(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = replay.encode([w.encode() for w in found])
        return np.array(list(map(len, ids)), np.int64), np.fromiter(chain.from_iterable(ids), np.int64)

    return PretokenCodes(words)


def encode(docs: DataFrame, *, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = text_encoder(MergeReplay(ranks))
        for batch in batches:
            codes, bounds = table.texts(batch.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, *, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, data)``: the bytes of ``(doc_id, ids)``; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(ranks)
        for batch in batches:
            data = [replay.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, data binary")


def round_trip_digests(docs: DataFrame, *, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one task, so that no ids are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(ranks)
        table = text_encoder(replay)
        digits = {rank: str(rank) for rank in replay.tokens}
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            codes, bounds = table.texts(batch.column(1).to_pylist())
            for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                ids = codes[first:last].tolist()
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(replay.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(id_and_text(docs, id_col, text_col), run,
                       "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
