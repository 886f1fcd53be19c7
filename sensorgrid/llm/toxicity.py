"""Toxicity by a factorization machine over hashed terms.

Terms are the letter words of a lower-cased text and the first ``PREFIX`` bytes of longer words, hashed to
``SPACE`` values.  A bounded sample of labelled rows counts, on the executors, in how many toxic
and other documents each term stands; the ``TERMS`` terms that part the classes best are the
inputs.  The machine adds to the linear weights a product of two small vectors for each pair
of terms that a document holds, so that two terms may weigh differently together.

Labels are learnt from at most ``PER_CLASS`` rows of each class (weighted back to the classes'
shares), equal texts once.  Every document is scored on its whole text; the score depends on the text alone.

Defined results: a null or empty text gets the score of a text without terms; a null id has no fold
(``held_out`` null).  Without labelled rows of both classes every score is the share of class 1 (0 if there is none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import block_rows, crc_fold, id_and_text, labelled_sample, map_batches, summed_blocks, text_buffer
from sensorgrid.llm.words import LETTER, WordHasher
from sensorgrid.session import stored

PER_CLASS = 8000
BITS, PREFIX, TERMS, FACTORS = 18, 4, 2048, 6
SPACE, BLOCKS = 1 << BITS, 64
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def hasher() -> WordHasher:
    return WordHasher(separate_marks=True, prefix=PREFIX)


def terms(words: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, term)`` of every word and prefix."""
    data, offsets = text_buffer(column)
    hashes, kind, text, prefix = words.words(data, offsets)
    whole, short = kind == LETTER, (kind == LETTER) & (prefix > 0)
    shift = np.uint64(64 - BITS)
    return (np.concatenate([text[whole], text[short]]),
            np.concatenate([hashes[whole] >> shift, prefix[short] >> shift]).astype(np.int64))


@dataclass
class Machine:
    """Input number of each term (-1: none), bias, linear weights and factors."""

    inputs: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def features(self, words: WordHasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(text number, input)`` of the different inputs of each text, in order."""
        text, term = terms(words, column)
        value = self.inputs[term]
        found = value >= 0
        pairs = np.unique(text[found] * len(self.weights) + value[found])
        return pairs // len(self.weights), pairs % len(self.weights)

    def scores(self, words: WordHasher, column: pa.Array) -> np.ndarray:
        n = len(column)
        text, value = self.features(words, column)
        linear = np.bincount(text, weights=self.weights[value], minlength=n)
        pairs = np.zeros(n)
        for v in self.factors.T:
            pairs += np.bincount(text, weights=v[value], minlength=n) ** 2
            pairs -= np.bincount(text, weights=v[value] ** 2, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -40, 40)))


def sample_texts(docs: DataFrame, labels: DataFrame, label_col: str, fold: int, parts: int, per_class: int,
                 id_col: str, text_col: str) -> DataFrame:
    """Texts of the labelled sample, equal ones once: ``(text, label, n_class)``; bounded by the sample."""
    picked = labelled_sample(labels, label_col, fold, parts, lambda rest: rest != fold, per_class)
    found = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    return stored(
        found.groupBy(F.xxhash64("text").alias("hash")).agg(
            F.min("text").alias("text"), F.max("label").alias("label"), F.max("n_class").alias("n_class")), "sample")


def class_terms(sample: DataFrame) -> np.ndarray:
    """Documents of class 0 and 1 (rows) with each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = hasher(), np.zeros((2, SPACE), np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            text, term = terms(words, batch.column(0))
            pairs = np.unique(text * SPACE + term)
            for c in (0, 1):
                totals[c] += np.bincount(pairs[label[pairs // SPACE] == c] % SPACE, minlength=SPACE)
        if totals.any():
            yield block_rows(totals.T.copy(), BLOCKS)

    partial = map_batches(sample.select(F.lower("text").alias("text"), "label"), count, "block int, data binary")
    return summed_blocks(partial, BLOCKS).reshape(-1, 2).T


def chosen_terms(counts: np.ndarray, sizes: np.ndarray, least: int = 3) -> np.ndarray:
    """Terms whose share differs most between the classes, in units of its standard error."""
    if counts.size == 0 or sizes.min() == 0:
        return np.zeros(0, np.int64)
    total = counts.sum(axis=0)
    share = total / sizes.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / sizes).sum())
    value = np.abs(counts[1] / sizes[1] - counts[0] / sizes[0]) / error
    value[total < least] = 0
    best = np.argsort(-value, kind="stable")[:TERMS]
    return np.sort(best[value[best] > 0])


def fit_machine(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, inputs: np.ndarray, *, epochs: int = 30,
                batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the weighted log loss of rows of input numbers."""
    n = int(inputs.max()) + 1
    rng = np.random.default_rng(seed)
    share = float((label * weight).sum() / weight.sum())
    state = [np.array([np.log(share / (1 - share))]), np.zeros(n), rng.normal(0, 0.03, (n, FACTORS))]
    first, second, step = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            x = np.zeros((len(part), n))
            for k, r in enumerate(part):
                x[k, rows[r]] = 1
            bias, linear, factors = state
            sums = x @ factors
            z = bias + x @ linear + ((sums ** 2).sum(1) - x @ (factors ** 2).sum(1)) / 2
            slope = weight[part] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[part]) / weight[part].sum()
            down = x.T @ slope
            grads = [np.array([slope.sum()]), down + decay * linear,
                     x.T @ (slope[:, None] * sums) - down[:, None] * factors + decay * factors]
            step += 1
            for p, g, m, v in zip(state, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Machine(inputs, float(state[0][0]), state[1], state[2])


def train(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT,
          per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    sample = sample_texts(docs, labels, label_col, held_out, folds, per_class, id_col, text_col)
    sizes = {r["label"]: r for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("n_class").alias("all")).collect()}
    inputs = np.full(SPACE, -1, np.int64)
    n = np.array([sizes[c]["n"] if c in sizes else 0 for c in (0, 1)])
    picked = chosen_terms(class_terms(sample), n) if n.min() else np.zeros(0, np.int64)
    inputs[picked] = np.arange(len(picked))
    known = np.array([sizes[c]["all"] if c in sizes else 0 for c in (0, 1)], float)
    share = known[1] / max(known.sum(), 1)
    if not len(picked):
        return Machine(inputs, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), np.zeros(1), np.zeros((1, FACTORS)))
    blank = Machine(inputs, 0.0, np.zeros(len(picked)), np.zeros((len(picked), FACTORS)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            text, value = blank.features(words, batch.column(0))
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found = [value[a:b].astype(np.uint16).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())],
                                             names=["hash", "label", "inputs"])

    # At most TERMS inputs of two bytes for each of the sample's rows come to the driver.
    rows = map_batches(sample.select(F.lower("text").alias("text"), "hash", "label"), look_up,
                       "hash bigint, label int, inputs binary").collect()
    rows.sort(key=lambda r: r["hash"])
    label = np.array([r["label"] for r in rows], float)
    weight = np.where(label == 1, known[1] / n[1], known[0] / n[0])
    return fit_machine([np.frombuffer(bytes(r["inputs"]), np.uint16).astype(np.int64) for r in rows], label, weight, inputs)


def held_out_row(doc_id: Column, folds: int = FOLDS, held_out: int = HELD_OUT) -> Column:
    return crc_fold(doc_id, folds) == held_out


def score_documents(docs: DataFrame, machine: Machine, *, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.scores(words, batch.column(1)))], names=["doc_id", "score"])

    rows = id_and_text(docs, id_col, text_col).withColumn("text", F.lower("text"))
    return map_batches(rows, score, "doc_id bigint, score double").select(
        "doc_id", held_out_row(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score under the threshold."""
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = hasher()
        for batch in batches:
            lowered = pa.array([(t or "").lower() for t in batch.column(at).to_pylist()], pa.string())
            yield batch.filter(pa.array(machine.scores(words, lowered) < threshold))

    return map_batches(docs, keep, docs.schema)
