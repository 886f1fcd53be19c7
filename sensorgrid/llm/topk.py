"""Exact top-k inner products by vector-approximation files.

Vectors become whole numbers and are dealt into parts of bounded size, a task for each, which holds
its part in chunks.  Each chunk has, beside the exact vectors, one cell number of ``CELLS`` for each
component.  For a block of queries the cells alone bound every inner product from above; exact
vectors are then read in the order of the bounds, best first, until the k-th score found in the part
is above every bound left.  Stated queries meet all rows in blocks: each block is shuffled to every
part and passes its chunks after the part's vectors are there, and k rows for each query leave a
part.  Nothing is joined or broadcast: Spark would take the blocks for all parts for as large as
those for one, and send them through the driver.

Defined results: null vectors, vectors with null, NaN or infinite components and rows with a null id
take no part, nor do vectors with a component whose ``scale``-fold is beyond the doubles.  Rows repeated with the same id and vector count once, and no row of the query's own id is a
candidate.  Only vectors of the same number of components are compared.  Scores beyond 64 bits
are cut to the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.llm.common import map_batches
from sensorgrid.session import wide

CELLS, CHUNK, BLOCK = 16, 4096, 512
#: A part of the vectors takes so many bytes as doubles, a block of queries so many components.
PART_BYTES, BLOCK_VALUES = 32 << 20, 1 << 18
#: Products under this are exact in doubles.
EXACT = float(1 << 53)


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, vec, dims)``: scale * x of the usable vectors, as doubles; repeated rows come repeatedly."""
    x = F.col(f"`{vector_col}`")
    scaled = F.transform(x, lambda v: v.cast("double") * F.lit(float(scale)))
    usable = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (
        df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), scaled.alias("vec"), F.size(x).alias("dims"), usable.alias("ok"))
        .filter("vec_id IS NOT NULL AND vec IS NOT NULL AND ok").select("vec_id", "vec", "dims")
    )


def narrowed(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the shortest type that holds them; doubles beyond 32 bits."""
    largest = np.abs(values).max(initial=0)
    return values.astype(np.int16 if largest < 1 << 15 else np.int32 if largest < 1 << 31 else np.float64)


def widened(data: pa.Buffer, rows: int, dims: int) -> np.ndarray:
    """The vectors of ``narrowed``, as doubles."""
    kind = {2: np.int16, 4: np.int32}.get(data.size // max(rows * dims, 1), np.float64)
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.float64)


def vectors_of(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and floors of the rows' vectors, which have ``dims`` components each."""
    values = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
    return batch.column("vec_id").to_numpy(), np.floor(values).reshape(batch.num_rows, dims)


def runs(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The rows that follow each other with the same values of the columns, with those values."""
    at = 0
    for key, same in groupby(zip(*(batch.column(c).to_pylist() for c in names))):
        n = sum(1 for _ in same)
        yield key, batch.slice(at, n)
        at += n


def packed(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows ``(vec_id, vec, dims)`` as rows ``(dims, ids, data)`` of many vectors of the same dimension."""

    def whole(dims: int, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, vectors = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array([dims], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([narrowed(vectors).tobytes()], pa.binary())],
            names=["dims", "ids", "data"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, found, n = 0, [], 0
        for batch in batches:
            for (dims,), same in runs(batch, "dims"):
                most = max(1, min(BLOCK, BLOCK_VALUES // max(dims, 1)))
                if found and dims != here:
                    yield whole(here, found)
                    found, n = [], 0
                here = dims
                while same.num_rows:
                    found.append(vectors_of(taken := same.slice(0, most - n), dims))
                    n, same = n + taken.num_rows, same.slice(taken.num_rows)
                    if n == most:
                        yield whole(dims, found)
                        found, n = [], 0
        if found:
            yield whole(here, found)

    dealt = rows.repartition(tasks, "vec_id", "vec").sortWithinPartitions("dims", "vec_id")
    return map_batches(dealt.select("dims", "vec_id", "vec"), pack, "dims int, ids binary, data binary")


class ApproximationFile:
    """Cells of the vectors of a chunk, and the least and greatest value of each cell."""

    def __init__(self, vectors: np.ndarray):
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        # Halves, because the difference of two large doubles can be beyond them.
        width = np.maximum(np.ceil(high / CELLS - low / CELLS + 1 / CELLS), 1)
        self.cells = np.minimum((vectors / 2 - low / 2) // (width / 2), CELLS - 1).astype(np.uint8)
        edges = np.minimum(low + np.arange(CELLS)[:, None] * width, high)
        columns = np.arange(vectors.shape[1])
        self.magnitude = np.maximum(np.abs(low), np.abs(high))
        self.least = edges[self.cells, columns]
        self.greatest = np.where(self.cells == CELLS - 1, high, np.minimum(np.maximum(self.least + (width - 1), self.least), high))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The greatest inner product that a vector in its cells can have with each query; infinite where doubles cannot tell."""
        with np.errstate(over="ignore", invalid="ignore"):
            found = np.maximum(queries, 0) @ self.greatest.T + np.minimum(queries, 0) @ self.least.T
        return np.where(np.isfinite(found), found, np.inf)

    def rounding(self, queries: np.ndarray) -> np.ndarray:
        """More than the bounds of each query can be off in doubles, whatever cancels out in them."""
        with np.errstate(over="ignore", invalid="ignore"):
            found = np.abs(queries) @ self.magnitude * 1e-9 + 0.5
        return np.where(np.isfinite(found), found, np.inf)


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, cut to 64 bits."""
    with np.errstate(over="ignore"):
        largest = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(len(query), 1)
    if largest < EXACT:
        return (vectors @ query).astype(np.int64)
    q = [int(v) for v in query]
    limit = 1 << 63
    return np.array([max(-limit, min(limit - 1, sum(int(a) * b for a, b in zip(row, q)))) for row in vectors], np.int64)


def chunk_best(file: ApproximationFile, ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
               k: int, found: list[dict[int, int]]) -> None:
    """Take the candidates of the chunk into ``found``, the k best candidates so far of each query with their scores."""
    # Scores are cut to 64 bits, so those below are equal.
    bounds = np.maximum(file.bounds(queries), -float(1 << 63))
    for at, (query_id, query, bound, rounding) in enumerate(zip(query_ids, queries, bounds, file.rounding(queries))):
        bound[ids == query_id] = -np.inf
        best, size = found[at], 16 * k
        while True:
            least = min(best.values()) if len(best) == k else -(1 << 63)
            fresh = np.flatnonzero((bound >= least - rounding) & (bound > -np.inf))
            if not len(fresh):
                break
            # The next vectors in the order of their bounds.
            if size < len(fresh):
                fresh = fresh[np.argpartition(-bound[fresh], size)[:size]]
            scores = products(vectors[fresh], query)
            good = scores >= least
            for s, i in zip(scores[good].tolist(), ids[fresh][good].tolist()):
                best[i] = max(s, best.get(i, s))
            best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            bound[fresh] = -np.inf
            size *= 8
        found[at] = best


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the k greatest inner products of each query row; ``is_query`` is over ``vec_id``."""
    every = whole_numbers(vectors, id_col, vector_col, scale)
    sizes = every.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.sum("dims").alias("values")).first()
    rows = every.distinct()
    # Enough parts for all cores, but none under a chunk, and none that a task cannot hold.
    parts = max(-(-8 * (sizes["n"] + (sizes["values"] or 0)) // PART_BYTES), min(-(-sizes["n"] // CHUNK), wide(vectors.sparkSession)), 1)
    tasks = min(-(-sizes["q"] // CHUNK) or 1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None).cast("binary")
    data = rows.select(F.expr(f"cast(pmod(xxhash64(vec_id, vec), {parts}) as int)").alias("part"), "dims", "vec_id", "vec",
                       none.alias("ids"), none.alias("data"))
    sent = packed(rows.filter(is_query), tasks).select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "dims",
        F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<double>").alias("vec"), "ids", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, n, chunks = None, [], 0, []

        def chunk() -> tuple[ApproximationFile, np.ndarray, np.ndarray]:
            ids, exact = (np.concatenate(x) for x in zip(*held))
            return ApproximationFile(exact), ids, exact

        for batch in batches:
            for (part, dims, asks), same in runs(batch.append_column("asks", batch.column("ids").is_valid()), "part", "dims", "asks"):
                if here != (part, dims):
                    here, held, n, chunks = (part, dims), [], 0, []
                if not asks:
                    held.append(vectors_of(same, dims))
                    n += same.num_rows
                if held and (asks or n >= CHUNK):
                    chunks.append(chunk())
                    held, n = [], 0
                if not asks or not chunks:
                    continue
                for row in range(same.num_rows):
                    query_ids = np.frombuffer(same.column("ids")[row].as_buffer(), np.int64)
                    queries = widened(same.column("data")[row].as_buffer(), len(query_ids), dims)
                    found: list[dict[int, int]] = [{} for _ in query_ids]
                    for file, ids, exact in chunks:
                        chunk_best(file, ids, exact, query_ids, queries, k, found)
                    best = [(q, i, s) for q, scores in zip(query_ids.tolist(), found) for i, s in scores.items()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b[c] for b in best], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    # The vectors of a part come before the blocks of queries.
    met = data.unionByName(sent).repartitionById(parts, "part").sortWithinPartitions("part", "dims", F.col("ids").isNotNull(), "vec_id")
    found = map_batches(met, search, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A candidate id with different vectors counts by its best one.
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return single.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
