"""Hourly means, enrichment and pairing on streams.

An hour is final once the watermark has passed its end.  Empty hours are not made up
on a stream; the grid is filled when the table is read as a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELAY = "2 hours"


def hourly_mean_stream(
    stream: DataFrame, keys: Sequence[str], values: Sequence[str], time: str = "timestamp", delay: str = DELAY
) -> DataFrame:
    """``keys, hour, values``: tumbling hourly means; late rows count up to ``delay``.

    State is one row of sums per key and open hour.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(*keys, F.window(time, "1 hour").alias("_w"))
        .agg(*[F.avg(v).alias(v) for v in values])
        .select(*keys, F.col("_w.start").alias("hour"), *values)
    )


def closed_hours(hourly: DataFrame, last: Column, hour: str = "hour", delay: str = DELAY) -> DataFrame:
    """Hours that are final when ``last`` is the latest event time seen."""
    return hourly.filter(F.col(hour) + F.expr("interval 1 hour") <= last - F.expr(f"interval {delay}"))


def enrich(stream: DataFrame, static: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a stream with a table (sensors, hourly weather); the table is read anew per batch."""
    return stream.join(static, list(on), how)


def pair_streams(
    dust: DataFrame,
    meteo: DataFrame,
    pairs: DataFrame,
    dust_values: Sequence[str] = ("P1", "P2"),
    meteo_values: Sequence[str] = ("pressure", "temperature", "humidity"),
    time: str = "timestamp",
    delay: str = DELAY,
) -> DataFrame:
    """Hourly dust with the hourly weather sensor of its pair, both as streams.

    Both sides are reduced to hours first, so the join state is bounded by sensors
    and open hours.  Dust without a partner comes out once its hour is final.
    """
    window = F.window(time, "1 hour").alias("w")
    left = (
        dust.withWatermark(time, delay)
        .groupBy("sds_sensor", window)
        .agg(*[F.avg(v).alias(v) for v in dust_values])
        .join(pairs.select("sds_sensor", "bme_sensor"), "sds_sensor")
    )
    right = (
        meteo.withWatermark(time, delay)
        .groupBy("bme_sensor", window)
        .agg(*[F.avg(v).alias(v) for v in meteo_values])
    )
    return left.join(right, ["bme_sensor", "w"], "left_outer").select(
        "sds_sensor", "bme_sensor", F.col("w.start").alias("hour"), *dust_values, *meteo_values
    )
