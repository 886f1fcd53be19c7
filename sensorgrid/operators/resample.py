"""Hourly means on a gap-filled grid and back-filled hourly observations.

Both reduce the readings to one row per key and hour with a map-side partial
aggregate before anything is shuffled.  A key that holds a third of all
readings is therefore as cheap as any other: what is left per key is bounded by
the number of hours, which is also what the window over the key sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def hourly_mean(
    readings: DataFrame,
    keys: Sequence[str],
    values: Sequence[str] | None = None,
    ts: str = "ts",
    hour: str = "hour",
    fill: bool = True,
) -> DataFrame:
    """Mean of ``values`` per key and hour.

    With ``fill`` the hours without readings between a key's first and last hour
    appear with NULL values.  Rows without a timestamp are left out.
    """
    values = list(values) if values is not None else numeric_columns(readings, exclude=keys)
    hourly = (
        readings.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias(hour))
        .agg(*[F.avg(v).alias(v) for v in values])
    )
    return fill_hours(hourly, keys, values, hour) if fill else hourly


def fill_hours(hourly: DataFrame, keys: Sequence[str], values: Sequence[str], hour: str = "hour") -> DataFrame:
    """Add the missing hours of every key, with NULL values.

    Each row spans the hours up to the next one of its key, so no separate grid
    is built and joined.
    """
    return explode_spans(hour_spans(hourly, keys, hour), keys, values, hour)


def hour_spans(hourly: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """Rows with ``_last``, the hour before the next row of the key; :func:`explode_spans` makes them rows by hour.

    Joins that need no filled hours go between the two, on rows Spark knows the size of.
    """
    key_window = Window.partitionBy(*keys).orderBy(hour) if keys else Window.orderBy(hour)
    return hourly.withColumn("_last", F.coalesce(F.lead(hour).over(key_window) - F.expr("interval 1 hour"), F.col(hour)))


def explode_spans(spans: DataFrame, keys: Sequence[str], values: Sequence[str], hour: str = "hour") -> DataFrame:
    """One row per hour of every span: ``keys`` in all of them, ``values`` in the first."""
    slots = spans.withColumn("_slot", F.explode(F.sequence(F.col(hour), F.col("_last"), F.expr("interval 1 hour"))))
    own = F.col("_slot") == F.col(hour)
    return slots.select(
        *keys,
        F.col("_slot").alias(hour),
        *[F.when(own, F.col(v)).alias(v) for v in values],
    )


def backfill_hours(
    observations: DataFrame,
    values: Sequence[str],
    keys: Sequence[str] = (),
    ts: str = "ts",
    hour: str = "hour",
) -> DataFrame:
    """Every hour takes the whole row of the first observation at or after it.

    NULLs inside that row stay NULL.  Hours run from the hour of a key's first
    observation to the hour of its last one.  An observation covers the hours
    behind the previous observed hour up to its own, so only the first
    observation of each hour matters; the rest is dropped by a partial
    aggregate.  Of several observations with one timestamp the least row is
    taken; :func:`repeated_stamps` lists them for callers that refuse such data.
    """
    one_hour = F.expr("interval 1 hour")
    key_window = Window.partitionBy(*keys).orderBy("_own") if keys else Window.orderBy("_own")
    firsts = (
        observations.filter(F.col(ts).isNotNull())
        .groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias("_own"))
        .agg(F.min(F.struct(F.col(ts).alias("_ts"), *[F.col(v) for v in values])).alias("_row"))
    )
    reach = F.coalesce(F.lag("_own").over(key_window) + one_hour, F.col("_own"))
    return firsts.withColumn("_from", reach).select(
        *keys,
        F.explode(F.sequence(F.col("_from"), F.col("_own"), one_hour)).alias(hour),
        *[F.col("_row").getField(v).alias(v) for v in values],
    )


def repeated_stamps(observations: DataFrame, keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Keys and timestamps that occur more than once, with their count."""
    return (
        observations.filter(F.col(ts).isNotNull())
        .groupBy(*keys, ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
