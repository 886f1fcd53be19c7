"""Seeded samples of sensors and rows, stable across partitionings and reruns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.operators.joins import of_sensors
from sensorgrid.operators.numbering import number_rows
from sensorgrid.session import stored

DEFAULT_SEED = 42


def draw_key(columns: Sequence[str], seed: int = DEFAULT_SEED) -> Column:
    """Pseudo-random, evenly spread text key of a row."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("#", *parts, F.lit(str(seed))).cast("binary"))


def sampled_ids(df: DataFrame, n, sensor: str = "sds_sensor", seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` distinct sensors; all of them when there are no more than ``n``.

    ``n`` is a number or a one-value column such as a scalar subquery.  Ids are
    ranked in 4,096 even hash buckets, so no task sorts all of them.  They are stored, since
    the ranking reads them twice.
    """
    ids = stored(df.select(sensor).distinct(), "sensor-ids").withColumn("_draw", draw_key([sensor], seed))
    ranked = number_rows(ids, ["_draw", sensor], F.substring("_draw", 1, 3), "_rank")
    n = F.lit(n) if isinstance(n, int) else n
    return ranked.filter(F.col("_rank") <= n).select(sensor)


def random_sensors(df: DataFrame, n, sensor: str = "sds_sensor", seed: int = DEFAULT_SEED) -> DataFrame:
    """All rows of ``n`` sampled sensors."""
    return of_sensors(df, sampled_ids(df, n, sensor, seed), sensor)


def sampled_rows(df: DataFrame, n: int, columns: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """``n`` rows drawn by the hash of ``columns``; every task keeps its ``n`` least."""
    key = draw_key(columns, seed)
    return df.select(*columns).orderBy(key, *columns).limit(n)


def refreshed_rows(
    old: DataFrame, new: DataFrame, m: int, columns: Sequence[str], keep: float = 0.7, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``m`` rows: the part ``keep`` drawn from ``old``, the rest from ``new``."""
    kept = int(keep * m)
    return sampled_rows(old, kept, columns, seed).unionByName(sampled_rows(new, m - kept, columns, seed))


def sampled_rows_by(
    df: DataFrame, group: str, n: int, columns: Sequence[str], seed: int = DEFAULT_SEED
) -> DataFrame:
    """``n`` rows per group; a map task passes on at most ``n`` rows of a group."""
    keyed = df.select(group, *columns).withColumn("_draw", draw_key(columns, seed))
    order = Window.partitionBy(group).orderBy("_draw", *columns)
    return keyed.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn", "_draw")


def sampled_ids_by(
    df: DataFrame, group: str, n: Column, sensor: str = "sds_sensor", seed: int = DEFAULT_SEED
) -> DataFrame:
    """``(group, sensor)`` of ``n`` sampled sensors per group, the same draw in every group."""
    ids = df.select(group, sensor).distinct().withColumn("_draw", draw_key([sensor], seed))
    order = Window.partitionBy(group).orderBy("_draw", sensor)
    return ids.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).select(group, sensor)
