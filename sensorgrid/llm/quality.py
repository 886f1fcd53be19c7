"""Quality scores: random-indexing word vectors pooled per document, and a two-layer network.

Every word (a run of letters, of digits or of marks, case kept) has a sparse random index vector of
``SIGNS`` entries of +1 or -1, taken from its hash.  A first pass over the whole corpus adds to
the context vector of each word's bucket the index vectors of its neighbours up to ``REACH`` words away.
A document is the frequency-damped mean of its words' context vectors, and how far it repeats words
(the length of its pooled index vector), repeats them in a row, and how long it is.

A network with one hidden layer learns from at most ``PER_CLASS`` labelled rows of each class, weighted
back to the classes' shares; a part of these rows, not used for the weights, sets one temperature
that calibrates the probabilities.  Scores depend on the text alone.

Defined results: a null or empty text is scored as a document without words; a null id has no fold
(``held_out`` null).  Without labelled rows of both classes every score is the share of class 1
(1 if there are no labels at all, so that nothing is rejected).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import block_rows, crc_fold, id_and_text, map_batches, summed_blocks, text_buffer
from sensorgrid.llm.toxicity import sample_texts
from sensorgrid.llm.words import WordHasher

PER_CLASS = 8000
BUCKET_BITS, DIMENSIONS, SIGNS, REACH = 13, 64, 4, 2
BUCKETS, BLOCKS = 1 << BUCKET_BITS, 128
#: Words of a share above this count less in the mean.
COMMON = 1e-3
HIDDEN = 32
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3


def hasher() -> WordHasher:
    return WordHasher(separate_marks=True, lower=False)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def index_entry(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of entry ``k`` of the words' index vectors."""
    place = ((hashes >> np.uint64(6 * k)) & np.uint64(DIMENSIONS - 1)).astype(np.int64)
    return place, 1.0 - 2.0 * ((hashes >> np.uint64(32 + k)) & np.uint64(1)).astype(np.float64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over the whole corpus, of length 1 and damped by frequency; last column: the damping."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums, seen = hasher(), np.zeros(BUCKETS * DIMENSIONS), np.zeros(BUCKETS)
        for batch in batches:
            hashes, _, text = words.words(*text_buffer(batch.column(0)))
            bucket = buckets(hashes)
            seen += np.bincount(bucket, minlength=BUCKETS)
            for k in range(SIGNS):
                place, sign = index_entry(hashes, k)
                for reach in range(1, REACH + 1):
                    near = text[reach:] == text[:-reach]
                    for centre, other in ((slice(None, -reach), slice(reach, None)), (slice(reach, None), slice(None, -reach))):
                        cells = bucket[centre][near] * DIMENSIONS + place[other][near]
                        sums += np.bincount(cells, weights=sign[other][near], minlength=len(sums))
        if seen.any():
            both = np.concatenate([sums.reshape(BUCKETS, DIMENSIONS), seen[:, None]], axis=1)
            yield block_rows(both.astype(np.int64), BLOCKS)

    total = summed_blocks(map_batches(docs.select("text"), count, "block int, data binary"), BLOCKS)
    if not len(total):
        return np.zeros((BUCKETS, DIMENSIONS + 1), np.float32)
    total = total.reshape(BUCKETS, DIMENSIONS + 1).astype(float)
    share = total[:, -1] / max(total[:, -1].sum(), 1)
    damping = COMMON / (COMMON + share)
    vectors = total[:, :-1] / np.maximum(np.linalg.norm(total[:, :-1], axis=1, keepdims=True), 1e-9)
    return np.concatenate([vectors * damping[:, None], damping[:, None]], axis=1).astype(np.float32)


def features(words: WordHasher, column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of ``DIMENSIONS + 3`` numbers for each text."""
    n = len(column)
    hashes, _, text = words.words(*text_buffer(column))
    size = np.bincount(text, minlength=n)
    cell = text * BUCKETS + buckets(hashes)
    pooled, repeats = np.zeros((n, vectors.shape[1])), np.zeros(n)
    for first in range(0, n, 128):
        last = min(n, first + 128)
        a, b = np.searchsorted(text, [first, last])
        counts = np.bincount(cell[a:b] - first * BUCKETS, minlength=(last - first) * BUCKETS).reshape(-1, BUCKETS).astype(np.float32)
        pooled[first:last] = counts @ vectors
        repeats[first:last] = np.einsum("ij,ij->i", counts, counts, dtype=np.float64)
    in_row = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n)
    some = np.maximum(size, 1)
    own = np.stack([np.log1p(size), np.sqrt(np.maximum(repeats - size, 0) / some ** 2), in_row / some], axis=1)
    return np.concatenate([pooled[:, :-1] / np.maximum(pooled[:, -1:], 1e-9), own], axis=1)


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def scores(self, words: WordHasher, column: pa.Array) -> np.ndarray:
        z = self.logits(features(words, column, self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def log_loss(z: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    return float((weight * (np.logaddexp(0, z) - label * z)).sum() / weight.sum())


def fit_network(vectors: np.ndarray, x: np.ndarray, label: np.ndarray, weight: np.ndarray, *, epochs: int = 40,
                batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the weighted log loss, then the temperature on every sixth row, which is kept back for it."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    net = Network(vectors, mean, scale, layers, 1.0)
    back = np.arange(len(x)) % 6 == 5
    use, z = np.flatnonzero(~back), (x - mean) / scale
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(epochs):
        pace = rate * (1 - epoch / epochs)
        for part in np.array_split(rng.permutation(use), max(1, len(use) // batch)):
            w1, b1, w2, b2 = layers
            inner = z[part] @ w1 + b1
            shown = np.maximum(inner, 0)
            out = shown @ w2 + b2[0]
            slope = weight[part] * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - label[part]) / weight[part].sum()
            down = (slope[:, None] * w2) * (inner > 0)
            step += 1
            grads = [z[part].T @ down + decay * w1, down.sum(0), shown.T @ slope + decay * w2, np.array([slope.sum()])]
            for p, g, m, v in zip(layers, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if back.any():
        out = net.logits(x[back])
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: log_loss(out / t, label[back], weight[back])))
    return net


def constant(share: float) -> Network:
    """A network that gives every text the same score."""
    width = DIMENSIONS + 3
    logit = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    return Network(np.zeros((BUCKETS, DIMENSIONS + 1), np.float32), np.zeros(width), np.ones(width),
                   [np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([logit])], 1.0)


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", folds: int = FOLDS, held_out: int = HELD_OUT,
          per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    sample = sample_texts(docs, labels, label_col, held_out, folds, per_class, id_col, text_col)
    known = {r["label"]: float(r["all"]) for r in sample.groupBy("label").agg(F.max("n_class").alias("all")).collect()}
    if len(known) < 2:
        return constant(1.0 if not known else float(min(known)))
    vectors = word_vectors(id_and_text(docs, id_col, text_col))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            x = features(words, batch.column(0), vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["hash", "label", "x"])

    # One short row of numbers for each of the sample's rows comes to the driver.
    rows = map_batches(sample.select("text", "hash", "label"), describe, "hash bigint, label int, x binary").collect()
    rows.sort(key=lambda r: r["hash"])
    label = np.array([r["label"] for r in rows], float)
    weight = np.where(label == 1, known[1] / label.sum(), known[0] / (1 - label).sum())
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in rows]).astype(float)
    return fit_network(vectors, x, label, weight)


def score_documents(docs: DataFrame, network: Network, *, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.scores(words, batch.column(1)))], names=["doc_id", "score"])

    rows = id_and_text(docs, id_col, text_col)
    return map_batches(rows, score, "doc_id bigint, score double").select(
        "doc_id", (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_poor(docs: DataFrame, network: Network, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            whole = pa.array([t or "" for t in batch.column(at).to_pylist()], pa.string())
            yield batch.filter(pa.array(network.scores(words, whole) >= threshold))

    return map_batches(docs, keep, docs.schema)
