"""Fourier transforms of one long series in two passes of short ones.

The places ``t = t1 * n2 + t2`` form a matrix.  Columns (equal ``t2``) are transformed in tasks, turned by a factor for each
cell, shuffled once as whole chunks, and transformed along rows; ``k = k1 + n1 * k2`` is the frequency.  A task holds some
columns or rows of about the square root of the length, never the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = "target int, source int, data binary"


@dataclass(frozen=True)
class Layout:
    """A power-of-two length as ``n1`` rows and ``n2`` columns, worked on ``columns`` and ``rows`` at a time."""

    n1: int
    n2: int
    columns: int
    rows: int

    @staticmethod
    def of(length: int, block: int) -> "Layout":
        """At least ``length`` places; about ``block`` values in a piece of work."""
        power = max(int(length - 1).bit_length(), 1)
        n2 = 1 << (power // 2) if power >= 4 else 1
        n1 = (1 << power) // n2
        fit = lambda other, n: max(1, min(n, 1 << (max(block // other, 1).bit_length() - 1)))
        return Layout(n1, n2, fit(n1, n2), fit(n2, n1))

    @property
    def length(self) -> int:
        return self.n1 * self.n2

    def turned(self, k1: np.ndarray, t2: np.ndarray, sign: int) -> np.ndarray:
        """exp(sign * 2 pi i * k1 * t2 / length), the product reduced as whole numbers."""
        return np.exp(sign * 2j * np.pi * ((k1[:, None] * t2[None, :]) % self.length) / self.length)

    def column_places(self, block: int) -> np.ndarray:
        """Places of a block of columns, ``(n1, columns)``."""
        return np.arange(self.n1)[:, None] * self.n2 + np.arange(block * self.columns, (block + 1) * self.columns)[None, :]

    def row_frequencies(self, block: int) -> np.ndarray:
        """Frequencies of a block of rows, ``(rows, n2)``."""
        return np.arange(block * self.rows, (block + 1) * self.rows)[:, None] + self.n1 * np.arange(self.n2)[None, :]

    def from_columns(self, block: int, values: np.ndarray) -> pd.DataFrame:
        """First pass: ``(..., n1, columns)`` values of a block of columns to chunks, one for each block of rows."""
        t2 = np.arange(block * self.columns, (block + 1) * self.columns)
        done = np.fft.fft(values, axis=-2) * self.turned(np.arange(self.n1), t2, -1)
        targets = range(self.n1 // self.rows)
        return pd.DataFrame({"target": targets, "source": block, "data": [
            np.ascontiguousarray(done[..., r * self.rows:(r + 1) * self.rows, :]).tobytes() for r in targets]})

    def at_rows(self, chunks: pd.DataFrame, signals: int = 1) -> np.ndarray:
        """Second pass: the chunks of a block of rows to their frequencies, ``(signals, rows, n2)``."""
        parts = [np.frombuffer(d, complex).reshape(signals, self.rows, self.columns) for d in chunks.sort_values("source")["data"]]
        return np.fft.fft(np.concatenate(parts, axis=2), axis=2)

    def from_rows(self, block: int, values: np.ndarray) -> pd.DataFrame:
        """Back, first pass: ``(rows, n2)`` frequencies of a block of rows to chunks, one for each block of columns."""
        k1 = np.arange(block * self.rows, (block + 1) * self.rows)
        done = np.fft.ifft(values, axis=1) * self.turned(k1, np.arange(self.n2), 1)
        targets = range(self.n2 // self.columns)
        return pd.DataFrame({"target": targets, "source": block, "data": [
            np.ascontiguousarray(done[:, c * self.columns:(c + 1) * self.columns]).tobytes() for c in targets]})

    def at_columns(self, chunks: pd.DataFrame) -> np.ndarray:
        """Back, second pass: the chunks of a block of columns to the values of its places, ``(n1, columns)``."""
        parts = [np.frombuffer(d, complex).reshape(self.rows, self.columns) for d in chunks.sort_values("source")["data"]]
        return np.fft.ifft(np.concatenate(parts, axis=0), axis=0)


def spectrum_product(series: DataFrame, layout: Layout, signals: Callable[[np.ndarray, np.ndarray], np.ndarray],
                     product: Callable[[np.ndarray], np.ndarray], out: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Transform, multiply at each frequency, transform back.

    ``series`` has dense ``(t, y)``.  ``signals(places, y)`` makes the padded signals ``(signals, n1, columns)`` of a block, with ``y`` 0 beyond the
    series; ``product`` takes their transforms to one; ``out(places, values)`` gives the rows of a block of results.
    """
    def forward(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(key[0])
        y = np.zeros((layout.n1, layout.columns))
        t = pdf["t"].to_numpy()
        y[t // layout.n2, t % layout.n2 - block * layout.columns] = pdf["y"].to_numpy()
        return layout.from_columns(block, signals(layout.column_places(block), y))

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        size = 16 * layout.rows * layout.columns
        found = layout.at_rows(pdf, len(pdf["data"].iloc[0]) // size)
        return layout.from_rows(int(key[0]), product(found))

    def back(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return out(layout.column_places(int(key[0])), layout.at_columns(pdf))

    placed = series.select(F.floor((F.col("t") % layout.n2) / layout.columns).cast("int").alias("source"), "t", "y")
    chunks = placed.groupBy("source").applyInPandas(forward, CHUNKS)
    chunks = chunks.groupBy("target").applyInPandas(multiply, CHUNKS)
    return chunks.groupBy("target").applyInPandas(back, schema)


def chirp(places: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i m^2 / n), the square reduced as whole numbers."""
    m = places % (2 * n)
    square = m.astype(object) ** 2 % (2 * n) if n > 1 << 30 else m * m % (2 * n)
    return np.exp(-1j * np.pi * np.asarray(square, float) / n)


def full_periodogram(series: DataFrame, n: int, block: int) -> DataFrame:
    """``(k, power)`` with ``power = |sum y exp(-2 pi i k t / n)|^2`` for k up to half of any length ``n``.

    The sum is a convolution with a chirp, so a transform of a power-of-two length gives the frequencies of exactly ``n``.
    """
    layout = Layout.of(2 * n, block)

    def signals(places: np.ndarray, y: np.ndarray) -> np.ndarray:
        # The chirp runs from -(n - 1) to n - 1; negative places stand at the end.
        behind = np.where(places < n, places, layout.length - places)
        ring = np.where((places < n) | (behind < n), np.conj(chirp(behind, n)), 0)
        return np.stack([y * chirp(places, n), ring])

    def out(places: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        keep = places <= n // 2
        return pd.DataFrame({"k": places[keep], "power": np.abs(values[keep]) ** 2})

    return spectrum_product(series, layout, signals, lambda x: x[0] * x[1], out, "k bigint, power double")


def lag_sums(series: DataFrame, n: int, block: int) -> DataFrame:
    """``(lag, s)`` with the sum of products ``y[t] * y[t + lag]`` for every lag under ``n``; zeros behind the series keep its ends apart."""

    def out(places: np.ndarray, values: np.ndarray) -> pd.DataFrame:
        keep = places < n
        return pd.DataFrame({"lag": places[keep], "s": values.real[keep]})

    return spectrum_product(
        series, Layout.of(2 * n, block), lambda places, y: y[None], lambda x: np.abs(x[0]) ** 2, out, "lag bigint, s double")
