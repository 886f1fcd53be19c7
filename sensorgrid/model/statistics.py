"""Sufficient statistics of the sparse model, summed on the executors.

For inducing points Z and rows (x, y) the model needs no more of the data than

    A = sum k(Z, x) k(x, Z)      b = sum k(Z, x) y      yy = sum y y
    n = count                    kd = sum k(x, x)

All are sums over rows.  Every task folds the rows that it scans into one M x M block per
group (a time fold) and candidate (a kernel); other tasks add the blocks up.  Rows are not shuffled where the scan is wide
enough, and what reaches the driver grows with groups x candidates x M x M, never with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.functions.kernels import Kernel
from sensorgrid.model.linalg import symmetric
from sensorgrid.session import spread_if_small, wide

X_COLUMNS = ["t", "lon", "lat"]
BLOCK_ROWS = 2048  # rows per kernel block inside a task
HELD_BYTES = 64 << 20  # partial sums a task holds before it hands them on
PIECE = 1 << 16  # numbers in a row of a partial sum
PARTIALS = "grp bigint, cand int, piece int, data binary"


@dataclass(frozen=True)
class Statistics:
    a: np.ndarray
    b: np.ndarray
    yy: float
    n: float
    kd: float

    def scaled(self, factor: float) -> "Statistics":
        """The statistics under the kernel times ``factor``."""
        return Statistics(self.a * factor**2, self.b * factor, self.yy, self.n, self.kd * factor)

    def __add__(self, other: "Statistics") -> "Statistics":
        return Statistics(
            self.a + other.a, self.b + other.b, self.yy + other.yy, self.n + other.n, self.kd + other.kd
        )


def block_statistics(kernel: Kernel, z: np.ndarray, x: np.ndarray, y: np.ndarray) -> Statistics:
    """Statistics of rows that fit one task's memory."""
    m = len(z)
    out = Statistics(np.zeros((m, m)), np.zeros(m), 0.0, 0.0, 0.0)
    for start in range(0, len(x), BLOCK_ROWS):
        xs, ys = x[start : start + BLOCK_ROWS], y[start : start + BLOCK_ROWS]
        k = kernel.matrix(z, xs)
        out = out + Statistics(k @ k.T, k @ ys, float(ys @ ys), float(len(ys)), float(kernel.diagonal(xs).sum()))
    return out


def _rows(grp: int, cand: int, s: Statistics) -> pd.DataFrame:
    """The scalars, b and the upper triangle of A as rows of bytes."""
    flat = np.concatenate([[s.yy, s.n, s.kd], s.b, s.a[np.triu_indices(len(s.b))]])
    pieces = [flat[at:at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
    return pd.DataFrame({"grp": grp, "cand": cand, "piece": range(len(pieces)), "data": pieces})


def _statistics(flat: np.ndarray, m: int) -> Statistics:
    a = np.zeros((m, m))
    a[np.triu_indices(m)] = flat[3 + m:]
    return Statistics(symmetric(a), flat[3:3 + m], *map(float, flat[:3]))


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Add the pieces that meet in a task."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    for pdf in batches:
        for *key, data in pdf.itertuples(index=False):
            part = np.frombuffer(data)
            sums[tuple(key)] = sums[tuple(key)] + part if tuple(key) in sums else part
    if sums:
        yield pd.DataFrame([(*key, s.tobytes()) for key, s in sums.items()], columns=["grp", "cand", "piece", "data"])


def sufficient_statistics(
    rows: DataFrame,
    points: Mapping[int, np.ndarray],
    kernels: Sequence[Kernel],
    group: str | None = None,
    y: str = "z",
) -> dict[tuple[int, int], Statistics]:
    """Statistics per ``(group, candidate)``.

    ``points`` gives the inducing points of every group (key 0 without ``group``); rows
    of other groups are left out.  ``rows`` holds ``t, lon, lat`` and ``y``.
    """
    kernels, points = list(kernels), dict(points)
    sizes = {g: len(z) for g, z in points.items()}
    held_max = max(1, HELD_BYTES // (8 * max(sizes.values()) ** 2 * len(kernels)))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[Statistics]] = {}
        for pdf in batches:
            for g, part in pdf.groupby("grp", sort=False):
                g = int(g)
                x, target = part[X_COLUMNS].to_numpy(float), part[y].to_numpy(float)
                new = [block_statistics(k, points[g], x, target) for k in kernels]
                if g in held:
                    held[g] = [a + b for a, b in zip(held[g], new)]
                    continue
                if len(held) >= held_max:
                    full, sums = held.popitem()
                    yield pd.concat([_rows(full, c, s) for c, s in enumerate(sums)])
                held[g] = new
        for g, sums in held.items():
            yield pd.concat([_rows(g, c, s) for c, s in enumerate(sums)])

    grp = F.col(group).cast("bigint") if group else F.lit(0).cast("bigint")
    used = rows.select(grp.alias("grp"), *X_COLUMNS, y).na.drop()
    tasks = wide(rows.sparkSession)
    salts = max(1, -(-tasks // len(points)))
    # A small table is dealt by group and a few salts, so that every task has rows of few groups.
    known = spread_if_small(used.filter(F.col("grp").isin(*points)), "grp", F.pmod(F.xxhash64(*X_COLUMNS, y), F.lit(salts)))
    partials = known.mapInPandas(fold, PARTIALS)
    sums = partials.repartition(tasks, "grp", "cand", "piece").mapInPandas(_summed, PARTIALS).collect()
    out: dict[tuple[int, int], Statistics] = {}
    for g, c in {(r["grp"], r["cand"]) for r in sums}:
        mine = sorted((r["piece"], bytes(r["data"])) for r in sums if (r["grp"], r["cand"]) == (g, c))
        out[(g, c)] = _statistics(np.frombuffer(b"".join(data for _, data in mine)), sizes[g])
    return out
