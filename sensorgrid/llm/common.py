"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A batch that goes to Python holds at most so many rows and bytes.
BATCH_ROWS = 500
BATCH_BYTES = 2 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def crc_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64, count=n + 1 + column.offset)[column.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def labelled_sample(labels: DataFrame, label_col: str, fold: int, parts: int, keep: Callable[[Column], Column],
                    per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, drawn by a hash of the id: ``(doc_id, label, n_class)``.

    ``keep`` says from the fold number which rows may be learnt from.  An id with rows of both
    labels counts as 1; null ids, null labels and labels other than 0 and 1 are not used.
    ``n_class`` is the count of all usable ids of the class, so that the draw can be weighted
    back to the share of the classes.
    """
    usable = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep(crc_fold(F.col("doc_id"), parts)))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    counts = usable.groupBy("label").agg(F.count(F.lit(1)).alias("n_class"))
    picks = [usable.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return picks[0].unionAll(picks[1]).join(F.broadcast(counts), "label").select("doc_id", "label", "n_class")


def block_rows(values: np.ndarray, blocks: int) -> pa.RecordBatch:
    """A vector cut into equal blocks of bytes, for ``summed_blocks``."""
    parts = np.ascontiguousarray(values).reshape(blocks, -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(blocks), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "data"])


def summed_blocks(partial: DataFrame, blocks: int, dtype: str = "int64") -> np.ndarray:
    """Sum vectors that tasks emitted by ``block_rows``; the sum has a fixed size and comes to the driver.

    The blocks are summed on the executors: each task holds one running sum for each block
    that it meets, however many partial vectors there are.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_buffer(), dtype)
                if block in sums:
                    sums[block] += part
                else:
                    sums[block] = part.copy()
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                names=["block", "data"])

    wide = max(int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = partial.repartition(wide, "block").mapInArrow(add, "block int, data binary").collect()
    found = {r["block"]: np.frombuffer(bytes(r["data"]), dtype) for r in rows}
    if not found:
        return np.zeros(0, dtype)
    size = len(next(iter(found.values())))
    return np.concatenate([found.get(b, np.zeros(size, dtype)) for b in range(blocks)])
