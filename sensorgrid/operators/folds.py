"""Anchored time folds and the prequential baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign_folds(
    df: DataFrame, time: str = "timestamp", step_hours: int = 24, include_last: bool = False, name: str = "fold"
) -> DataFrame:
    """Number the tumbling windows that start at the earliest timestamp.

    Windows are half-open.  A window exists only if it starts before the latest
    timestamp, so a row exactly on the last boundary has none; ``include_last``
    keeps it.
    """
    rows = df.filter(F.col(time).isNotNull())
    span = rows.agg(F.struct(F.min(time).alias("first"), F.max(time).alias("last"))).scalar()
    step = F.lit(step_hours * 3_600_000_000)
    offset = F.timestamp_diff("MICROSECOND", span["first"], F.col(time))
    fold = F.floor(offset / step).cast("bigint")
    folds = rows.withColumn(name, fold)
    if include_last:
        return folds
    length = F.timestamp_diff("MICROSECOND", span["first"], span["last"])
    return folds.filter(F.col(name) * step < length)


def fold_steps(folds: DataFrame, fold: str = "fold", name: str = "step") -> DataFrame:
    """One row per non-empty fold with its place among them, counted from 0."""
    distinct = folds.select(fold).distinct()
    return distinct.withColumn(name, (F.row_number().over(Window.orderBy(fold)) - 1).cast("bigint"))


def prequential_mean(folds: DataFrame, fold: str = "fold", y: str = "P1") -> DataFrame:
    """Score every fold with the mean of all earlier rows: ``fold, pred, rmse``.

    The squared error of a constant prediction follows from the count, sum and
    sum of squares of a fold, so rows are read once and only one row per fold
    is ordered.
    """
    sums = folds.groupBy(fold).agg(
        F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q")
    )
    earlier = Window.orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    pred = F.sum("s").over(earlier) / F.sum("n").over(earlier)
    mse = (F.col("q") - F.lit(2.0) * F.col("pred") * F.col("s")) / F.col("n") + F.col("pred") * F.col("pred")
    return (
        sums.withColumn("pred", pred)
        .filter(F.col("pred").isNotNull())
        .select(fold, "pred", F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))
    )
