"""Centroid clustering with exact whole-number distances from bit planes.

Components become whole numbers in two's complement, and the bits of one weight of a vector's 64 components are one uint64: a plane.
The inner product of vector and centroid is the sum over pairs of planes of popcount(plane AND plane) times the product of their
weights, so ``|x|^2 - 2 x.c + |c|^2`` is exact.  The table of planes is written once, some twelve numbers a vector for
components under one; each round scans it, sums components and counts by centroid in the tasks, and brings one sum for each
centroid to the driver.  No shuffle carries vectors.

Planes follow the data: vectors whose numbers leave ``NARROW`` bits go through the same products in Python's whole numbers,
so every finite component is exact.

Defined results: vectors that are null, of another length than 64, or hold null, NaN or infinite components take no part.
A row with a null id is clustered like the others but starts a centroid only where rows with an id are too few.  Repeated rows are
vectors of their own.  With fewer vectors than centroids every vector starts one.  A distance or inertia
beyond 64 bits is cut to the largest long.  Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.llm.common import map_batches
from sensorgrid.session import stored

#: Components of a vector; one bit of each fills a plane.
WIDTH = 64
#: Numbers of so many bits keep every distance under 2^63.
NARROW = 28
LARGEST = (1 << 63) - 1


def whole_components(vector: list[float], scale: int) -> list[int]:
    """floor(scale * x) of each component, exact for every finite double."""
    return [floor(Fraction(x) * scale) for x in vector]


def planes_of(values: np.ndarray, width: int) -> np.ndarray:
    """``(n, width)`` uint64 planes of ``(n, 64)`` whole numbers in two's complement."""
    out = np.empty((len(values), width), np.uint64)
    for bit in range(width):
        bits = np.array((values >> bit) & 1, np.uint8)
        out[:, bit] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The whole numbers of ``(n, width)`` planes; 64-bit ones, or Python's where they are wider than ``NARROW``."""
    n, width = planes.shape
    wide = width > NARROW
    out = np.zeros((n, WIDTH), object if wide else np.int64)
    for bit in range(width):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, bit]).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        out += bits.astype(object if wide else np.int64) * weight(bit, width)
    return out


def weight(bit: int, width: int) -> int:
    """Value of a bit: powers of two, the last one negative."""
    return -(1 << bit) if bit == width - 1 else 1 << bit


def bits_needed(values: np.ndarray) -> int:
    """Bits that hold all the values in two's complement."""
    return max((int(v) if v >= 0 else ~int(v)).bit_length() for v in (values.min(), values.max())) + 1


def inner_products(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Inner products of ``(n, a)`` planes with the ``(b,)`` planes of a centroid."""
    a, b = planes.shape[1], len(centroid)
    kind = object if a > NARROW or b > NARROW else np.int64
    weights = np.array([weight(i, a) for i in range(a)], kind)
    out = np.zeros(len(planes), kind)
    for j in np.flatnonzero(centroid).tolist():
        out += np.bitwise_count(planes & centroid[j]).astype(kind) @ weights * weight(j, b)
    return out


def square_lengths(planes: np.ndarray) -> np.ndarray:
    """Squared length of each vector, from the products of its own planes."""
    width = planes.shape[1]
    kind = object if width > NARROW else np.int64
    weights = np.array([weight(i, width) for i in range(width)], kind)
    out = np.zeros(len(planes), kind)
    for j in range(width):
        out += np.bitwise_count(planes & planes[:, j:j + 1]).astype(kind) @ weights * weight(j, width)
    return out


class Centroids:
    """Centroids as whole numbers and as planes."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.planes, self.norms = [], []
        for v in vectors:
            row = np.array([v], object)
            width = bits_needed(row)
            self.planes.append(planes_of(row if width > NARROW else row.astype(np.int64), width)[0])
            self.norms.append(sum(x * x for x in v))

    def nearest(self, planes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller number of equally near ones, and ``|c|^2 - 2 x.c`` of it."""
        table = np.stack([m - 2 * inner_products(planes, p) for p, m in zip(self.planes, self.norms)])
        best = table.argmin(axis=0)
        return best, table[best, np.arange(len(planes))]

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in self.vectors]


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vec)``: the vectors of 64 finite components, as doubles."""
    x = F.col(f"`{vector_col}`")
    usable = (F.size(x) == WIDTH) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(x, lambda v: v.cast("double")).alias("vec"),
                          usable.alias("ok")).filter("vec IS NOT NULL AND ok").select("vec_id", "vec")


def plane_table(rows: DataFrame, scale: int) -> DataFrame:
    """``(vec_id, width, planes)`` of usable vectors: the planes of each, as many as its numbers need, as bytes."""
    #: Under this, scale * x is exact in doubles and 64-bit numbers hold the floor.
    plain = float(1 << 53) / scale

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.array(batch.column(1).to_pylist(), np.float64)
            narrow = (np.abs(raw).max(axis=1) < plain) if scale & (scale - 1) == 0 else np.zeros(len(raw), bool)
            widths, data = np.zeros(len(raw), np.int32), [b""] * len(raw)
            for row in np.flatnonzero(~narrow).tolist():
                values = np.array([whole_components(raw[row].tolist(), scale)], object)
                widths[row] = bits_needed(values)
                data[row] = planes_of(values, int(widths[row])).tobytes()
            if narrow.any():
                whole = np.floor(raw[narrow] * scale).astype(np.int64)
                # One width for the batch, the one its largest number needs.
                width = bits_needed(whole)
                widths[narrow] = width
                for row, planes in zip(np.flatnonzero(narrow).tolist(), planes_of(whole, width)):
                    data[row] = planes.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(widths), pa.array(data, pa.binary())], names=["vec_id", "width", "planes"])

    return map_batches(rows, cut, "vec_id bigint, width int, planes binary")


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and planes of a batch, for each width of planes in it."""
    widths = batch.column("width").to_numpy()
    data = batch.column("planes").to_pylist()
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        yield rows, np.frombuffer(b"".join(data[k] for k in rows.tolist()), np.uint64).reshape(len(rows), width)


def first_centroids(rows: DataFrame, k: int, scale: int, seed: str) -> list[list[int]]:
    """The k vectors with the least sha256 of ``<seed><vec_id>``, in that order; those of equal ids by their components."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [whole_components(r["vec"], scale) for r in rows.orderBy(key.asc_nulls_last(), "vec").limit(k).collect()]


def centroid_sums(table: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for _, planes in _by_width(batch):
                best, _ = centroids.nearest(planes)
                values = values_of(planes)
                for c in np.unique(best).tolist():
                    mine = values[best == c]
                    counts[c] = counts.get(c, 0) + len(mine)
                    sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * WIDTH), mine.sum(axis=0))]
        yield _sum_rows(counts, sums)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for c, n, total in zip(*(batch.column(k).to_pylist() for k in range(3))):
                counts[c] = counts.get(c, 0) + n
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * WIDTH), total)]
        yield _sum_rows(counts, sums)

    schema = "cluster int, n bigint, total array<string>"
    partial = map_batches(table, add, schema)
    # One row for each centroid and task; tasks add those of their centroids.
    rows = partial.repartition(max(len(centroids.vectors), 1), "cluster").mapInArrow(join, schema).collect()
    return {r["cluster"]: (r["n"], [int(t) for t in r["total"]]) for r in rows}


def _sum_rows(counts: dict[int, int], sums: dict[int, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64()),
         pa.array([[str(v) for v in sums[c]] for c in counts], pa.list_(pa.string()))], names=["cluster", "n", "total"])


def moved(table: DataFrame, vectors: list[list[int]], rounds: int) -> Centroids:
    """Centroids after ``rounds`` of assigning all vectors and replacing each by the floor of its vectors' mean; empty ones stay."""
    centroids = Centroids(vectors)
    for _ in range(rounds if vectors else 0):
        sums = centroid_sums(table, centroids)
        centroids = Centroids([[t // sums[c][0] for t in sums[c][1]] if c in sums else v for c, v in enumerate(centroids.vectors)])
    return centroids


def assign(table: DataFrame, centroids: Centroids) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector of a plane table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for rows, planes in _by_width(batch):
                cluster[rows], rest = centroids.nearest(planes)
                far = square_lengths(planes) + rest
                distance[rows] = [min(int(d), LARGEST) for d in far] if far.dtype == object else far
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return map_batches(table, run, "vec_id bigint, cluster int, distance bigint")


def cluster_vectors(vectors: DataFrame, *, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every usable vector."""
    rows = usable_vectors(vectors, id_col, vector_col)
    table = stored(plane_table(rows, scale), "planes")
    centroids = moved(table, first_centroids(rows, k, scale, seed), rounds)
    placed = stored(assign(table, centroids), "clusters")
    # At most k rows.
    sums = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(19,0)")).alias("total")).collect()}
    digests = centroids.digests()
    told = [(c, min(t, LARGEST), min(sum(sums.values()), LARGEST), digests[c]) for c, t in sums.items()]
    told = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
