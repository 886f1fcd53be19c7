"""Global row numbers without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(
    df: DataFrame, order: Sequence[str | Column], bucket: Column, name: str = "row_number"
) -> DataFrame:
    """1-based position of every row in the order of ``order``.

    ``bucket`` must not fall when ``order`` rises.  Rows are numbered inside their
    bucket and moved up by the row count of the buckets before it; only the
    bucket counts are ordered in one task.
    """
    tagged = df.withColumn("_bucket", bucket)
    counts = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_bucket").orderBy(*order)
    return (
        tagged.withColumn("_pos", F.row_number().over(inner))
        .join(offsets, tagged["_bucket"].eqNullSafe(offsets["_bucket"]))
        .withColumn(name, F.col("_pos") + F.col("_offset"))
        .drop("_pos", "_offset", "_bucket")
    )


def quantile_bucket(df: DataFrame, column: str, buckets: int = 200) -> Column:
    """Rising bucket number by approximate quantiles of a numeric column.

    Runs one job to find the bounds; at most ``buckets`` numbers reach the driver.
    """
    bounds = sorted(set(df.approxQuantile(column, [i / buckets for i in range(1, buckets)], 0.5 / buckets)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(column)))


def day_bucket(ts: str) -> Column:
    return F.to_date(F.col(ts))


def chunks(df: DataFrame, size: int, order: Sequence[str], bucket: Column, item: str) -> DataFrame:
    """``size`` consecutive rows per chunk: ``(chunk, items)``; the last may be short."""
    numbered = number_rows(df, order, bucket, "_rn")
    entry = F.struct(F.col("_rn"), F.col(item).alias("_item"))
    return (
        numbered.withColumn("chunk", F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint"))
        .groupBy("chunk")
        .agg(F.sort_array(F.collect_list(entry)).alias("_items"))
        .select("chunk", F.transform("_items", lambda e: e.getField("_item")).alias("items"))
    )
