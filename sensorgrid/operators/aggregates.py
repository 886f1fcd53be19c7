"""Aggregates over readings; all combine on the map side before the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.config import DEFAULT_LOAD_DAYS
from sensorgrid.functions import scalar
from sensorgrid.operators.resample import numeric_columns

# --- fixed values: feature groups of the correlation study ---------------------------
SPACE_FEATURES = ["sealevel_alt", "surface_alt", "nearest_park", "nearest_road", "nearest_indust"]
METEO_FEATURES = ["temp_meteo", "pres_meteo", "hum_meteo", "wind_speed"]
# -----------------------------------------------------------------------------


def city_mean(df: DataFrame, time: str = "timestamp", values: Sequence[str] | None = None) -> DataFrame:
    """Mean of all numeric columns per timestamp."""
    values = list(values) if values is not None else numeric_columns(df, exclude=[time])
    return df.groupBy(time).agg(*[F.avg(v).alias(v) for v in values])


def last_known(df: DataFrame, columns: Sequence[str], sensor: str = "sds_sensor", time: str = "timestamp") -> DataFrame:
    """Latest non-NULL value of every column per sensor."""
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(time))).alias(c) for c in columns]
    return df.groupBy(sensor).agg(*aggs)


def fold_errors(predictions: DataFrame, fold: str = "fold", y: str = "P1", pred: str = "pred") -> DataFrame:
    """``mse`` and ``rmse`` per fold."""
    squared = F.pow(F.col(y) - F.col(pred), 2)
    return (
        predictions.groupBy(fold)
        .agg(F.avg(squared).alias("mse"))
        .withColumn("rmse", F.sqrt("mse"))
    )


def error_summary(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the fold RMSE."""
    return folds.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("rmse_std"))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise complete Pearson correlation, long form ``(a, b, corr)``.

    All pairs are computed in one aggregate over one scan.
    """
    columns = list(columns)
    upper = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggs = [F.corr(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(upper)]
    # A column correlates with itself at 1 unless it has no spread.
    aggs += [F.corr(a, a).alias(f"_d{i}") for i, a in enumerate(columns)]
    row = df.agg(*aggs)
    cells = []
    for i, (a, b) in enumerate(upper):
        cells += [(a, b, f"_c{i}"), (b, a, f"_c{i}")]
    cells += [(a, a, f"_d{i}") for i, a in enumerate(columns)]
    entries = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("corr")) for a, b, c in cells]
    )
    return row.select(F.inline(entries))


def log_correlation(df: DataFrame, features: Sequence[str], target: str = "P1") -> DataFrame:
    """Correlation of the features and the logarithm of the target."""
    return correlation_matrix(df.withColumn(target, F.ln(target)), [*features, target])


def fit_target(df: DataFrame, target: str = "P1", time: str = "timestamp") -> DataFrame:
    """One row ``mean, sd, start``: log-target mean and population spread, earliest time."""
    z = F.ln(target)
    return df.agg(
        F.avg(z).alias("mean"),
        scalar.unit_if_zero(F.stddev_pop(z)).alias("sd"),
        F.min(time).alias("start"),
    )


def first_rows(df: DataFrame, key: str, order: Sequence, n: int, name: str = "rn") -> DataFrame:
    """The first ``n`` rows of every key, numbered; each map task passes on at most ``n`` rows of a key."""
    ranked = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(ranked)).filter(F.col(name) <= n)


def sample_position(readings: DataFrame, file: str = "file", time: str = "timestamp", columns: Sequence[str] = ()) -> DataFrame:
    """The second row of every file in time order, or its only row.

    Each map task passes on at most two rows per file.
    """
    first_two = first_rows(readings.select(file, time, *columns), file, [F.col(time).asc_nulls_last(), *columns], 2, "_rn")
    row = F.struct("_rn", time, *columns)
    return first_two.groupBy(file).agg(F.max(row).alias("_r")).select(file, *[F.col("_r")[c].alias(c) for c in columns])


def high_water(df: DataFrame, key: str | Sequence[str], time: str = "timestamp") -> DataFrame:
    """First day not yet loaded per key: the day after its last row."""
    keys = [key] if isinstance(key, str) else list(key)
    return (
        df.filter(F.col(time).isNotNull())
        .groupBy(*keys)
        .agg(F.date_add(F.to_date(F.max(time)), 1).alias("next_day"))
    )


def load_start(marks: DataFrame, default_day, name: str = "start_day") -> DataFrame:
    """Start of the next load: the later of the default day and the high-water mark."""
    return marks.withColumn(name, scalar.later_of(default_day, F.coalesce(F.col("next_day"), default_day)))


def default_load_day(today, days: int = DEFAULT_LOAD_DAYS):
    return F.date_sub(today, days)


def sensor_ids(df: DataFrame, sensor: str = "sds_sensor") -> DataFrame:
    return df.select(sensor).distinct()


def sample_size(df: DataFrame, fraction: float = 0.25, sensor: str = "sds_sensor") -> DataFrame:
    """One row ``n``: the given part of the distinct sensors, halves rounded to even."""
    return df.agg(scalar.half_even(F.count_distinct(sensor) * F.lit(fraction)).cast("bigint").alias("n"))


def at_latest(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Rows at the latest timestamp; the maximum reaches the scan as a pushed filter."""
    return df.filter(F.col(time) == df.agg(F.max(time)).scalar())


def hexagon_mean(
    df: DataFrame, values: Sequence[str], x: str = "lon", y: str = "lat", gridsize: int = 30
) -> DataFrame:
    """Mean of ``values`` and row count per hexagon of the extent of the data.

    ``gridsize`` hexagons span the x range and as many the y range as keeps them
    regular.  Their centres form two interleaved lattices; a point belongs to the
    nearer of the two centres next to it.
    """
    rows = int(gridsize / math.sqrt(3.0))
    extent = df.agg(F.struct(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")
    )).scalar()

    def place(axis: str, cells: int, low: str, high: str):
        width = F.col("_e")[high] - F.col("_e")[low]
        # A tiny pad keeps the extreme points off the lattice edge; an extent of one value is widened by a tenth of it.
        pad = F.when(width > 0, width * F.lit(1e-9)).otherwise(
            F.when(F.col("_e")[low] == 0, F.lit(0.1)).otherwise(F.abs(F.col("_e")[low]) * F.lit(0.1)))
        start, stop = F.col("_e")[low] - pad, F.col("_e")[high] + pad
        return (F.col(axis) - start) / ((stop - start) / F.lit(float(cells)))

    def off(axis: str, centre) -> Column:
        return (F.col(axis) - centre) * (F.col(axis) - centre)

    placed = df.select(F.col(x), F.col(y), *values, extent.alias("_e")).withColumns(
        {"_u": place(x, gridsize, "x0", "x1"), "_v": place(y, rows, "y0", "y1")}
    )
    near = {"_iu": F.rint("_u"), "_iv": F.rint("_v"), "_ju": F.floor("_u"), "_jv": F.floor("_v")}
    to_even = off("_u", F.col("_iu")) + F.lit(3.0) * off("_v", F.col("_iv"))
    to_odd = off("_u", F.col("_ju") + 0.5) + F.lit(3.0) * off("_v", F.col("_jv") + 0.5)
    cells = placed.withColumns(near).withColumn("_even", to_even < to_odd)
    return (
        cells.select(
            F.when(F.col("_even"), 0).otherwise(1).alias("lattice"),
            F.when(F.col("_even"), F.col("_iu")).otherwise(F.col("_ju")).cast("bigint").alias("ix"),
            F.when(F.col("_even"), F.col("_iv")).otherwise(F.col("_jv")).cast("bigint").alias("iy"),
            *values,
        )
        .groupBy("lattice", "ix", "iy")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    )
