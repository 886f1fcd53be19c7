"""Embedding whitening from an exact characteristic polynomial.

Components become whole numbers, so the scatter ``n * sum(y y') - S S'`` is a matrix of whole numbers: n^2 times the
covariance, whatever the order in which tasks add.  From there nothing is rounded until the end:

* the characteristic polynomial modulo many primes, each by reduction to Hessenberg form, as rows of a Spark job; Chinese
  remainders give the whole coefficients;
* all roots are real, so the sign changes of the polynomial shifted to a place count the roots above it exactly; halving isolates
  every root and refines it to a relative error under 2^-``DIGITS``.  The rank is exact too: the zero coefficients at the end;
* components solve ``(scatter - root) v = b`` twice in fixed-point numbers of several hundred bits (null-space inverse iteration); vectors of roots
  that stay together are made orthogonal to each other, so repeated eigenvalues get a basis.

Only the sums of d x d numbers, the coefficients and the components come to the driver.

Defined results: null vectors and those with null, NaN or infinite entries take no part, nor do vectors of another length than most
rows have (of equally frequent lengths the greater counts), nor those with an entry whose whole number leaves 64 bits.
Rows with a null id and repeated rows count and are returned.  Directions without variance have no components, as
nothing can be divided by their eigenvalue.  A deviation beyond 64 bits is cut to the largest long.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.llm.common import map_batches
from sensorgrid.session import stored

#: Roots are refined to a relative error of 2^-DIGITS.
DIGITS = 120
#: Bits behind the point in the inverse iteration, beyond those of the roots.
GUARD = 160
LARGEST = (1 << 63) - 1
#: Values under this keep a block's products and sums in 64 bits.
SMALL = 1 << 24


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``(vec_id, y)``: floor(scale * c) of the usable vectors of the most frequent length, as longs."""
    x = F.col(f"`{vector_col}`")
    bound = float((1 << 63) - 1025 - abs(shift)) / scale
    fits = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < bound))
    rows = vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), x.alias("vec"), F.size(x).alias("dims"), fits.alias("ok")).filter("dims > 0 AND ok")
    most = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    dims = most[0]["dims"] if most else 0
    return rows.filter(F.col("dims") == dims).select("vec_id", F.transform("vec", lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint")).alias("y"))


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Scatter:
    """Count, sums and the scatter ``n * sum(y y') - S S'``, in Python's whole numbers."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def scatter(rows: DataFrame) -> Scatter | None:
    """Sums over all rows, added by tasks and then by rows of the matrix; None without rows."""
    schema = "line int, n bigint, total string, products array<string>"

    def emit(n: int, sums: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array([str(v) for v in sums], pa.string()),
             pa.array([[str(v) for v in line] for line in products], pa.list_(pa.string()))], names=["line", "n", "total", "products"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = matrix_of(batch.column(0))
            if max(abs(int(y.min())), abs(int(y.max()))) >= SMALL:
                y = y.astype(object)
            if sums is None:
                sums, products = np.zeros(y.shape[1], object), np.zeros((y.shape[1], y.shape[1]), object)
            n += len(y)
            sums += y.sum(axis=0).astype(object)
            products += (y.T @ y).astype(object)
        if n:
            yield emit(n, sums, products)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[int, int, list[int]]] = {}
        for batch in batches:
            for line, n, total, products in zip(*(batch.column(k).to_pylist() for k in range(4))):
                m, s, p = lines.get(line, (0, 0, [0] * len(products)))
                lines[line] = (m + n, s + int(total), [a + int(b) for a, b in zip(p, products)])
        for line, (n, s, p) in lines.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([line], pa.int32()), pa.array([n], pa.int64()), pa.array([str(s)]), pa.array([[str(v) for v in p]], pa.list_(pa.string()))],
                names=["line", "n", "total", "products"])

    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = map_batches(rows.select("y"), add, schema).repartition(wide, "line").mapInArrow(join, schema).orderBy("line").collect()
    if not lines:
        return None
    n, sums = lines[0]["n"], [int(r["total"]) for r in lines]
    products = np.array([[int(v) for v in r["products"]] for r in lines], object)
    return Scatter(n, sums, n * products - np.outer(np.array(sums, object), np.array(sums, object)))


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t I - matrix) modulo a prime p under 2^31, leading one first, by way of the Hessenberg form."""
    d = len(matrix)
    h = np.array(matrix % p, np.int64)
    for m in range(1, d - 1):
        nonzero = np.flatnonzero(h[m:, m - 1])
        if not len(nonzero):
            continue
        pivot = m + int(nonzero[0])
        if pivot != m:
            h[[m, pivot]] = h[[pivot, m]]
            h[:, [m, pivot]] = h[:, [pivot, m]]
        factors = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - factors[:, None] * h[m] % p) % p
        # The inverse transformation adds the eliminated columns to column m, one product at a time under 2^62.
        h[:, m] = (h[:, m] + (h[:, m + 1:] * factors % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(d):
        new = np.zeros(k + 2, np.int64)
        new[:-1] = polys[k]
        new[1:] = (new[1:] - h[k, k] * polys[k]) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            new[k + 1 - i:] = (new[k + 1 - i:] - (int(h[i, k]) * below % p) * polys[i]) % p
        polys.append(new % p)
    return polys[d].tolist()


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest primes below ``top``."""
    small = [q for q in range(2, isqrt(top) + 1) if all(q % r for r in range(2, isqrt(q) + 1))]
    found, high = [], top
    while len(found) < count:
        low = max(high - (1 << 16), 2)
        sieve = np.ones(high - low, bool)
        for q in small:
            sieve[(-low) % q::q] = False
        found += (low + np.flatnonzero(sieve)[::-1]).tolist()
        high = low
    return found[:count]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Whole coefficients of det(t I - matrix), leading one first; one row of a Spark job for each prime."""
    d = len(matrix)
    # |c_k| is at most the k-th elementary symmetric function of eigenvalues not over the trace (none is negative).
    bits = d * (max(int(np.trace(matrix)), 1).bit_length() + 1) + 2
    primes = primes_below(1 << 31, bits // 30 + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([hessenberg_polynomial(matrix, p)], pa.list_(pa.int64()))],
                                                 names=["prime", "residues"])

    rows = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(min(len(primes), 2 * spark.sparkContext.defaultParallelism))
    found = {r["prime"]: r["residues"] for r in rows.mapInArrow(residues, "prime bigint, residues array<bigint>").collect()}
    value, modulus = [0] * (d + 1), 1
    for p in primes:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, found[p])]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in value]


def shifted(poly: list[int], at: int, bits: int) -> list[int]:
    """Coefficients of a positive multiple of p(t + at / 2^bits), leading one first."""
    # p(t / 2^bits) scaled to whole numbers, then moved by a whole number.
    out = [c << (bits * k) for k, c in enumerate(poly)]
    for end in range(len(out), 1, -1):
        for k in range(1, end):
            out[k] += at * out[k - 1]
    return out


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """How many roots of a polynomial with real roots alone lie above at / 2^bits: the sign changes of the shifted coefficients."""
    signs = [c > 0 for c in shifted(poly, at, bits) if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """The greatest positive roots as ``(numerator, bits, multiplicity)``: numerator / 2^bits with relative error under 2^-DIGITS.

    Roots that are closer than that count as one, with their number as multiplicity.
    """
    poly = list(poly)
    while len(poly) > 1 and poly[-1] == 0:
        poly.pop()
    total = len(poly) - 1
    if total == 0:
        return []
    top = max(abs(c) for c in poly).bit_length() + 1
    found, wanted = [], min(count, total)
    # Intervals (low, high] / 2^bits with the numbers of roots above low and above high, greatest first.
    bound = 1 << min(top, (-poly[1]).bit_length() + 1)
    stack = [(0, bound, 0, total, 0)]
    while stack and sum(f[2] for f in found) < wanted:
        low, high, bits, above_low, above_high = stack.pop()
        inside = above_low - above_high
        if low and (high - low) << DIGITS <= low:
            found.append((low + high, bits + 1, inside))
            continue
        if inside == 1:
            found.append((*refined(poly, low, high, bits), 1))
            continue
        if high - low == 1:
            low, high, bits = low << 8, high << 8, bits + 8
        mid = (low + high) // 2
        above = roots_above(poly, mid, bits)
        # The upper half is looked at first.
        if above_low > above:
            stack.append((low, mid, bits, above_low, above))
        if above > above_high:
            stack.append((mid, high, bits, above, above_high))
    return found


def value_at(poly: list[int], at: int, bits: int) -> int:
    """2^(bits * degree) * p(at / 2^bits)."""
    total = 0
    for k, c in enumerate(poly):
        total = total * at + (c << (bits * k))
    return total


def refined(poly: list[int], low: int, high: int, bits: int) -> tuple[int, int]:
    """The one root in (low, high] / 2^bits: halving by the sign, with secant steps where they shrink the interval."""
    at_high = value_at(poly, high, bits)
    if at_high == 0:
        return high, bits
    rising = at_high > 0
    while not (low and (high - low) << DIGITS <= low):
        if high - low < 1 << 20:
            low, high, bits = low << 32, high << 32, bits + 32
        mid = (low + high) // 2
        a, b = value_at(poly, low, bits), value_at(poly, high, bits)
        width = high - low
        if a != b and (a < 0) != (b < 0):
            # A narrow interval around the secant's root, if the signs at its ends prove that it holds the root.
            guess = low - a * width // (b - a)
            reach = max(width >> 12, 1)
            left, right = max(guess - reach, low), min(guess + reach, high)
            x, y = value_at(poly, left, bits), value_at(poly, right, bits)
            if y == 0:
                return right, bits
            if (y > 0) == rising and (x > 0) != rising:
                low, high = left, right
                continue
        m = value_at(poly, mid, bits)
        if m == 0:
            return mid, bits
        low, high = (low, mid) if (m > 0) == rising else (mid, high)
    return (low + high) // 2, bits


def null_vectors(matrix: np.ndarray, root: int, bits: int, count: int) -> list[list[int]]:
    """``count`` orthogonal vectors that ``matrix - root / 2^bits`` nearly sends to 0, in fixed-point numbers, by inverse iteration.

    The matrix is factored once, with the largest pivots; a pivot that vanishes is replaced by one unit.
    """
    d = len(matrix)
    # Scaled so that the largest entry is about 1.
    size = max(int(np.abs(matrix).max()), 1).bit_length()
    point = DIGITS + GUARD
    a = [[(int(v) << point) >> size for v in line] for line in matrix]
    value = ((root << point) >> bits) >> size
    for k in range(d):
        a[k][k] -= value
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[best] = a[best], a[k]
        order[k], order[best] = order[best], order[k]
        if a[k][k] == 0:
            a[k][k] = 1
        line = a[k]
        for r in range(k + 1, d):
            if a[r][k]:
                f = (a[r][k] << point) // line[k]
                row = a[r]
                row[k] = f
                for c in range(k + 1, d):
                    row[c] -= f * line[c] >> point
    found: list[list[int]] = []
    for start in range(count):
        v = [(1 << point) // (1 + (k * (2 * start + 3) + start) % (d + 1)) * (-1 if (k * k + start) % 3 == 1 else 1) for k in range(d)]
        for _ in range(3):
            v = unit(_solve(a, order, v, point), found, point)
        found.append(v)
    return found


def _solve(lu: list[list[int]], order: list[int], b: list[int], point: int) -> list[int]:
    d = len(b)
    x = [b[k] for k in order]
    for k in range(d):
        x[k] -= sum(lu[k][c] * x[c] for c in range(k)) >> point
    for k in range(d - 1, -1, -1):
        x[k] = ((x[k] << point) - sum(lu[k][c] * x[c] for c in range(k + 1, d))) // lu[k][k]
    return x


def unit(v: list[int], others: list[list[int]], point: int) -> list[int]:
    """v at right angles to the others and of length 1, the entry of largest size positive."""
    for turn in (0, 1):
        length = isqrt(sum(x * x for x in v)) or 1
        v = [(x << point) // length for x in v]
        for o in others if not turn else ():
            part = sum(x * y for x, y in zip(v, o)) >> point
            v = [x - (part * y >> point) for x, y in zip(v, o)]
    return v if max(v, key=abs) >= 0 else [-x for x in v]


@dataclass
class Whitening:
    """Mean and components of a fit list."""

    n: int
    sums: list[int]
    #: Columns: unit components over the square root of their root.
    axes: np.ndarray
    explained: list[float]

    def deviations(self, y: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """n * y - S as doubles, and the exact sum of its squares."""
        largest = max(abs(int(y.min())), abs(int(y.max())), 1)
        exact = self.n * largest + max(map(abs, self.sums))
        if exact * exact * y.shape[1] < LARGEST:
            d = self.n * y - np.array(self.sums, np.int64)
            return d.astype(np.float64), (d * d).sum(axis=1).tolist()
        d = self.n * y.astype(object) - np.array(self.sums, object)
        return d.astype(np.float64), [min(int(v), LARGEST) for v in (d * d).sum(axis=1)]


def component_axes(spark: SparkSession, matrix: np.ndarray, roots: list[tuple[int, int, int]], components: int) -> list[list[float]]:
    """Unit components over the square root of their root; one row of a Spark job for each root."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, root, bits, count in zip(*(batch.column(k).to_pylist() for k in range(4))):
                root = int(root)
                # The square root of root / 2^bits with GUARD bits behind the point.
                length = isqrt((root << 2 * GUARD) >> bits)
                lines = [[x / (length << DIGITS) for x in v] for v in null_vectors(matrix, root, bits, count)]
                yield pa.RecordBatch.from_arrays([pa.array([place] * count, pa.int32()), pa.array(lines, pa.list_(pa.float64()))], names=["place", "axis"])

    if not roots:
        return []
    rows = spark.createDataFrame([(k, str(root), bits, count) for k, (root, bits, count) in enumerate(roots)],
                                 "place int, root string, bits int, count int").repartition(len(roots), "place")
    found = rows.mapInArrow(solve, "place int, axis array<double>").collect()
    return [list(r["axis"]) for r in sorted(found, key=lambda r: r["place"])][:components]


def fit(rows: DataFrame, components: int = 32) -> Whitening | None:
    """The whitening of ``(vec_id, y)``; None without rows."""
    total = scatter(rows)
    if total is None:
        return None
    poly = characteristic_polynomial(rows.sparkSession, total.matrix)
    roots = largest_roots(poly, components)
    axes, trace = component_axes(rows.sparkSession, total.matrix, roots, components), int(np.trace(total.matrix))
    explained = [root / (trace << bits) for root, bits, count in roots for _ in range(count)][:components]
    return Whitening(total.n, total.sums, np.array(axes, np.float64).T, explained)


def whitened_rows(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """``(vec_id, deviation, whitened)`` with an array of the whitened components of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d, squares = fitted.deviations(matrix_of(batch.column(1)))
                z = d @ fitted.axes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(squares, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))],
                    names=["vec_id", "deviation", "whitened"])

    return map_batches(rows.select("vec_id", "y"), run, "vec_id bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, n: int, size: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity, measured over all rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                z = matrix_of(batch.column(0))
                sums += z.sum(axis=0)
                products += z.T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array(sums), pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * size, pa.int32()), pa.array(products.ravel()))],
            names=["line", "total", "products"])

    # The mean is 0 but for rounding, so products need no further centring.
    parts = map_batches(white.select("whitened"), add, "line int, total double, products array<double>")
    lines = parts.select("line", F.posexplode("products").alias("at", "value"), "total").groupBy("line", "at").agg(
        F.sum("value").alias("value"), F.sum("total").alias("total")).collect()
    covariance, mean = np.zeros((size, size)), np.zeros(size)
    for r in lines:
        covariance[r["line"], r["at"]], mean[r["line"]] = r["value"] / n, r["total"] / n
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(size)).max(initial=0.0))


def whiten(vectors: DataFrame, *, components: int = 32, scale: int = 64, shift: int = 1_000_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each usable row and component."""
    spark = vectors.sparkSession
    rows = stored(usable_vectors(vectors, id_col, vector_col, scale, shift), "whitening-rows")
    fitted = fit(rows, components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if fitted is None or not fitted.explained:
        return spark.createDataFrame([], schema)
    white = stored(whitened_rows(rows, fitted), "whitened")
    error = identity_error(white, fitted.n, len(fitted.explained))
    shares = F.array(*(F.lit(e) for e in fitted.explained))
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
