"""Autocovariance and periodogram of one long series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.operators import fourier
from sensorgrid.operators.numbering import day_bucket, number_rows
from sensorgrid.session import stored

BLOCK = 4096
#: Values in a piece of a transform.
BLOCK_VALUES = 1 << 16


def indexed_series(df: DataFrame, y: str, time: str = "timestamp") -> DataFrame:
    """``(t, y)`` with ``t`` the 0-based place of the row in time order; NULLs left out.

    The series is stored: what follows reads it several times, and it is far smaller
    than the readings it was made from.
    """
    rows = stored(df.select(F.col(time), F.col(y).cast("double").alias("y")).na.drop(), "series")
    numbered = number_rows(rows, [time], day_bucket(time), "_rn")
    return stored(numbered.select((F.col("_rn") - 1).cast("bigint").alias("t"), "y"), "indexed-series")


def _lag_sums(max_lag: int):
    """Sum of products by lag for pairs of blocks, folded over an Arrow batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            acc: dict[int, np.ndarray] = {}
            for shift, size, a, b in zip(pdf["shift"], pdf["size"], pdf["a"], pdf["b"]):
                a, b = np.asarray(a, float), np.asarray(b, float)
                n = 1 << int(np.ceil(np.log2(len(a) + len(b))))
                full = np.fft.irfft(np.fft.rfft(b, n) * np.conj(np.fft.rfft(a, n)), n)
                # full[d] pairs a[i] with b[i + d]; negative d sit at the end.
                row = np.concatenate([full[n - (len(a) - 1):] if len(a) > 1 else full[:0], full[: len(b)]])
                first = int(shift) * int(size) - (len(a) - 1)
                key = (first, len(row))
                acc[key] = acc[key] + row if key in acc else row
            for (first, count), row in acc.items():
                lag = np.arange(first, first + count)
                keep = (lag >= 0) & (lag <= max_lag)
                yield pd.DataFrame({"lag": lag[keep], "s": row[keep]})

    return run


def autocovariance(series: DataFrame, max_lag: int | None = None, block: int | None = None) -> DataFrame:
    """``(lag, acov)`` of an indexed series, demeaned and divided by its length.

    All lags by default, by a Fourier transform over tasks whose work grows as n log n.  With ``max_lag`` the
    series is cut into blocks of at most ``block`` values; each block meets the blocks at most ``max_lag``
    behind it and the products of a pair of blocks are summed by lag inside a task.  Neither way does the
    series pass through one task.
    """
    if max_lag is None:
        mean, n = series.agg(F.avg("y"), F.count("y")).first()
        if not n:
            return series.select(F.col("t").cast("bigint").alias("lag"), F.col("y").alias("acov"))
        sums = fourier.lag_sums(series.select("t", (F.col("y") - F.lit(mean)).alias("y")), n, block or BLOCK_VALUES)
        return sums.select("lag", (F.col("s") / F.lit(float(n))).alias("acov"))
    block = block or BLOCK
    stats = series.agg(F.struct(F.avg("y").alias("mean"), F.count("y").alias("n")).alias("s")).scalar()
    blocks = (
        series.select(
            F.floor(F.col("t") / block).cast("bigint").alias("block"), "t", (F.col("y") - stats["mean"]).alias("y")
        )
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("t", "y"))).alias("v"))
        .select("block", F.transform("v", lambda e: e.getField("y")).alias("v"))
    )
    last = F.ceil(stats["n"] / F.lit(block)).cast("bigint") - 1
    reach = F.least(last - F.col("block"), F.lit((max_lag + block - 1) // block).cast("bigint"))
    left = blocks.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), reach)).alias("shift"), "block", F.col("v").alias("a")
    ).withColumn("block", F.col("block") + F.col("shift"))
    pairs = left.join(blocks.withColumnRenamed("v", "b"), "block").select(
        "shift", F.lit(block).cast("bigint").alias("size"), "a", "b"
    )
    sums = pairs.mapInPandas(_lag_sums(max_lag), "lag bigint, s double")
    return sums.groupBy("lag").agg((F.sum("s") / stats["n"]).alias("acov"))


def periodogram(series: DataFrame, max_index: int | None = None, y: str = "y") -> DataFrame:
    """``(k, freq, power)``: one-sided power density at unit sampling, mean removed.

    ``series`` has a dense 0-based ``t``.  All indices up to half the length by default, by a Fourier transform over
    tasks.  A plot of the daily cycles needs no more than ``max_index=72``: then sums for every index are combined
    on the map side, so the work is rows times indices and the shuffle one row per task and index.
    """
    if max_index is None:
        mean, n = series.agg(F.avg(y), F.count(y)).first()
        if not n:
            return series.select(F.col("t").cast("bigint").alias("k"), F.col(y).alias("freq"), F.col(y).alias("power"))
        found = fourier.full_periodogram(series.select("t", (F.col(y) - F.lit(mean)).alias("y")), n, BLOCK_VALUES)
        once = (F.col("k") == 0) | (F.col("k") * 2 == n)
        return found.select("k", (F.col("k") / F.lit(float(n))).alias("freq"),
                            (F.col("power") / F.lit(float(n)) * F.when(once, F.lit(1.0)).otherwise(F.lit(2.0))).alias("power"))
    stats = series.agg(F.struct(F.avg(y).alias("mean"), F.count(y).alias("n")).alias("s")).scalar()
    half = F.floor(stats["n"] / F.lit(2)).cast("bigint")
    top = F.least(half, F.lit(max_index).cast("bigint"))
    spread = series.select(
        "t", (F.col(y) - stats["mean"]).alias("v"), F.explode(F.sequence(F.lit(0).cast("bigint"), top)).alias("k")
    )
    # k * t is reduced modulo n as whole numbers, so the angle stays exact.
    angle = F.lit(2.0) * F.pi() * ((F.col("k") * F.col("t")) % stats["n"]) / stats["n"]
    sums = spread.groupBy("k").agg(
        F.sum(F.col("v") * F.cos(angle)).alias("re"), F.sum(F.col("v") * F.sin(angle)).alias("im")
    )
    single = (F.col("k") == 0) | (F.col("k") * 2 == stats["n"])
    return sums.select(
        "k",
        (F.col("k") / stats["n"]).alias("freq"),
        ((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / stats["n"]
         * F.when(single, F.lit(1.0)).otherwise(F.lit(2.0))).alias("power"),
    )
