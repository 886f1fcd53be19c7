"""Covariance functions, vectorised for Arrow batches and as column expressions.

A kernel is a small tree of plain numbers, so it can be shipped to executors,
written to a state table and varied for a candidate search.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Kernel:
    """Common behaviour: sum, product, JSON form."""

    def __add__(self, other: "Kernel") -> "Kernel":
        return Combined("sum", (self, other))

    def __mul__(self, other: "Kernel") -> "Kernel":
        return Combined("product", (self, other))

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Covariance of the rows of ``a`` and ``b``.

        Hourly rows share few times and few places, so a kernel is worked out on the
        distinct values of its dimensions where these are clearly fewer than the rows.
        """
        dims = sorted(self.active())
        if 0 < len(dims) < b.shape[1] and len(b) > 1:
            part = b[:, dims[0]] if len(dims) == 1 else b[:, dims]
            values, first, place = np.unique(
                part, axis=None if len(dims) == 1 else 0, return_index=True, return_inverse=True
            )
            if 2 * len(values) <= len(b):
                return self.raw_matrix(a, b[first])[:, place.ravel()]
        return self.raw_matrix(a, b)

    def active(self) -> set[int]:
        """Dimensions the kernel looks at."""
        raise NotImplementedError

    def raw_matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def diagonal(self, a: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def column(self, a: list[Column], b: list[Column]) -> Column:
        raise NotImplementedError

    def to_json(self) -> str:
        return json.dumps(self.as_dict())


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] == 1:
        return np.abs(np.subtract.outer(a[:, 0], b[:, 0]))
    out = np.zeros((a.shape[0], b.shape[0]))
    for d in range(a.shape[1]):
        out += np.subtract.outer(a[:, d], b[:, d]) ** 2
    return np.sqrt(out)


@dataclass(frozen=True)
class Matern32(Kernel):
    """variance * (1 + sqrt(3) r) exp(-sqrt(3) r), r = |x - x'| / lengthscale."""

    dims: tuple[int, ...]
    lengthscale: float = 1.0
    variance: float = 1.0

    def active(self):
        return set(self.dims)

    def raw_matrix(self, a, b):
        r = _distance(a[:, self.dims], b[:, self.dims]) * (math.sqrt(3.0) / self.lengthscale)
        return self.variance * (1.0 + r) * np.exp(-r)

    def diagonal(self, a):
        return np.full(a.shape[0], self.variance)

    def column(self, a, b):
        total = F.lit(0.0)
        for d in self.dims:
            total = total + (a[d] - b[d]) * (a[d] - b[d])
        r = F.sqrt(F.lit(3.0) * total) / F.lit(float(self.lengthscale))
        return F.lit(float(self.variance)) * (F.lit(1.0) + r) * F.exp(-r)

    def as_dict(self):
        return {"type": "matern32", "dims": list(self.dims), "lengthscale": self.lengthscale, "variance": self.variance}


@dataclass(frozen=True)
class Periodic(Kernel):
    """variance * exp(-0.5 * sum_d (sin(pi d / period) / lengthscale)^2)."""

    dims: tuple[int, ...]
    period: float = 1.0
    lengthscale: float = 1.0
    variance: float = 1.0

    def active(self):
        return set(self.dims)

    def raw_matrix(self, a, b):
        total = np.zeros((a.shape[0], b.shape[0]))
        for d in self.dims:
            total += (np.sin(np.pi * np.subtract.outer(a[:, d], b[:, d]) / self.period) / self.lengthscale) ** 2
        return self.variance * np.exp(-0.5 * total)

    def diagonal(self, a):
        return np.full(a.shape[0], self.variance)

    def column(self, a, b):
        total = F.lit(0.0)
        for d in self.dims:
            s = F.sin(F.lit(math.pi) * (a[d] - b[d]) / F.lit(float(self.period))) / F.lit(float(self.lengthscale))
            total = total + s * s
        return F.lit(float(self.variance)) * F.exp(F.lit(-0.5) * total)

    def as_dict(self):
        return {
            "type": "periodic", "dims": list(self.dims), "period": self.period,
            "lengthscale": self.lengthscale, "variance": self.variance,
        }


@dataclass(frozen=True)
class Constant(Kernel):
    """The same covariance everywhere."""

    variance: float = 1.0

    def active(self):
        return set()

    def raw_matrix(self, a, b):
        return np.full((a.shape[0], b.shape[0]), self.variance)

    def diagonal(self, a):
        return np.full(a.shape[0], self.variance)

    def column(self, a, b):
        return F.lit(float(self.variance))

    def as_dict(self):
        return {"type": "constant", "variance": self.variance}


@dataclass(frozen=True)
class Combined(Kernel):
    """Sum or product of kernels."""

    how: str
    parts: tuple[Kernel, ...]

    def _fold(self, values):
        values = list(values)
        out = values[0]
        for v in values[1:]:
            out = out + v if self.how == "sum" else out * v
        return out

    def active(self):
        return set().union(*(p.active() for p in self.parts))

    def raw_matrix(self, a, b):
        return self._fold(p.matrix(a, b) for p in self.parts)

    def diagonal(self, a):
        return self._fold(p.diagonal(a) for p in self.parts)

    def column(self, a, b):
        return self._fold(p.column(a, b) for p in self.parts)

    def as_dict(self):
        return {"type": self.how, "parts": [p.as_dict() for p in self.parts]}


def kernel_from_dict(d: dict) -> Kernel:
    if d["type"] == "matern32":
        return Matern32(tuple(d["dims"]), d["lengthscale"], d["variance"])
    if d["type"] == "periodic":
        return Periodic(tuple(d["dims"]), d["period"], d["lengthscale"], d["variance"])
    if d["type"] == "constant":
        return Constant(d["variance"])
    return Combined(d["type"], tuple(kernel_from_dict(p) for p in d["parts"]))


def kernel_from_json(text: str) -> Kernel:
    return kernel_from_dict(json.loads(text))


# --- fixed values: default kernel parameters; dimension 0 is time in hours,
# --- 1 and 2 are longitude and latitude ----------------------------------------
TIME_LENGTHSCALE = 5.0
SPACE_LENGTHSCALE = 0.05
PERIODIC_LENGTHSCALE = 12.0
PERIODS = (8.0, 10.0, 30.0, 2.0)
# -----------------------------------------------------------------------------


def time_cov(
    lengthscale: float = TIME_LENGTHSCALE,
    modulated_lengthscale: float = TIME_LENGTHSCALE,
    variance: float = 1.0,
    modulated_variance: float = 1.0,
) -> Kernel:
    """Smooth trend plus a trend-modulated sum of periodic parts."""
    cycles = Combined("sum", tuple(Periodic((0,), period=p, lengthscale=PERIODIC_LENGTHSCALE) for p in PERIODS))
    trend = Matern32((0,), lengthscale, variance)
    return trend + Matern32((0,), modulated_lengthscale, modulated_variance) * cycles


def space_cov(lengthscale: float = SPACE_LENGTHSCALE, variance: float = 1.0) -> Kernel:
    return Matern32((1, 2), lengthscale, variance)


def get_kernel(name: str) -> Kernel:
    """``time_cov`` (time only) or ``basic`` (time x space)."""
    kernels = {"time_cov": time_cov, "basic": lambda: time_cov() * space_cov()}
    return kernels[name]()


def scaled(kernel: Kernel, factor: float) -> Kernel:
    """The kernel times a constant variance."""
    return kernel if factor == 1.0 else Constant(factor) * kernel
