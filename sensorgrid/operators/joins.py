"""Equi-joins of readings, weather, sensor dimension, links and samples.

Small sides are broadcast by adaptive execution after it has measured them, larger ones
are sort-merged with skew handling.  Rows that fill gaps come out of a generator, whose
output Spark takes for as large as its input: joins of filled hours are hinted, so
that those hours are never the side that is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.config import STATION_ALTITUDE_M
from sensorgrid.functions import scalar, text
from sensorgrid.operators import resample
from sensorgrid.operators.select import dust_sensors, meteo_sensors
from sensorgrid.schemas import SENSOR_DIMENSION_COLUMNS


def pair_colocated(positions: DataFrame) -> DataFrame:
    """Dust and weather sensors at exactly the same place: ``sds_sensor, bme_sensor, lat, lon``.

    Every dust sensor meets every weather sensor of its place; unknown
    coordinates match nothing.
    """
    clean = positions.withColumns({"lat": scalar.nan_to_null(F.col("lat").cast("double")),
                                   "lon": scalar.nan_to_null(F.col("lon").cast("double"))})
    dust = dust_sensors(clean).select("lat", "lon", F.col("sensor_id").alias("sds_sensor"))
    meteo = meteo_sensors(clean).select("lat", "lon", F.col("sensor_id").alias("bme_sensor"))
    return dust.join(meteo, ["lat", "lon"], "inner").select("sds_sensor", "bme_sensor", "lat", "lon")


def attach_meteo(
    dust_hourly: DataFrame,
    meteo_hourly: DataFrame,
    pairs: DataFrame,
    columns: Sequence[str] = ("pressure", "temperature", "humidity"),
    pair_columns: Sequence[str] = (),
    fill: Sequence[str] = (),
) -> DataFrame:
    """Hourly dust of every pair, left-joined with the hourly weather sensor of the pair.

    ``pair_columns`` are taken over from ``pairs`` by the same join.  With ``fill``, the value
    columns of ``dust_hourly``, the hours missing between a dust sensor's first and last one
    appear as well, and both frames hold one row per sensor and hour, as ``hourly_mean(fill=False)``
    gives them; filling after the join keeps the filled hours out of its shuffles.
    """
    if fill:
        return _attach_meteo_and_fill(dust_hourly, meteo_hourly, pairs, fill, columns, pair_columns)
    paired = dust_hourly.hint("merge").join(pairs.select("sds_sensor", "bme_sensor", *pair_columns), "sds_sensor")
    meteo = meteo_hourly.select("bme_sensor", "hour", *columns)
    return paired.join(meteo.hint("merge"), ["bme_sensor", "hour"], "left")


def _attach_meteo_and_fill(
    dust_hourly: DataFrame,
    meteo_hourly: DataFrame,
    pairs: DataFrame,
    values: Sequence[str],
    columns: Sequence[str],
    pair_columns: Sequence[str],
) -> DataFrame:
    """Hours of either sensor of a pair side by side, dealt once by pair, and filled there.

    Weather hours outside the dust sensor's first and last hour are dropped; those inside
    one of its gaps are hours that filling would have added.
    """
    pair = F.struct("sds_sensor", "bme_sensor").alias("_pair")  # structs are equal where both ids are null
    known = pairs.select("sds_sensor", "bme_sensor").distinct()
    own = dust_hourly.join(known, "sds_sensor").select(pair, "hour", *values, F.col("hour").alias("_own"))
    paired = meteo_hourly.join(known, "bme_sensor").select(pair, "hour", *columns)
    hours = own.unionByName(paired, allowMissingColumns=True).filter(F.col("hour").isNotNull()).repartition("_pair")
    # The dust row of an hour comes first and takes over the values of the weather row behind it.
    per_pair = Window.partitionBy("_pair")
    by_hour = per_pair.orderBy("hour", F.col("_own").asc_nulls_last())
    taken = F.col("_own").isNotNull() & (F.col("hour") == F.lead("hour").over(by_hour))
    inside = (
        hours.withColumns({c: F.when(taken, F.lead(c).over(by_hour)).otherwise(F.col(c)) for c in columns} | {
            "_over": F.col("_own").isNull() & F.coalesce(F.col("hour") == F.lag("hour").over(by_hour), F.lit(False)),
            "_first": F.min("_own").over(per_pair),
            "_last": F.max("_own").over(per_pair),
        })
        .filter(~F.col("_over") & F.col("hour").between(F.col("_first"), F.col("_last")))
    )
    described = pairs.select(pair, "sds_sensor", "bme_sensor", *pair_columns)
    spans = resample.hour_spans(inside, ["_pair"]).join(described, "_pair")
    names = ["bme_sensor", "hour", "sds_sensor", *values, *pair_columns, *columns]
    return resample.explode_spans(spans, ["bme_sensor", "sds_sensor", *pair_columns], [*values, *columns]).select(*names)


def attach_weather(readings: DataFrame, weather: DataFrame, hour: str = "hour") -> DataFrame:
    """Left join of hourly station weather.

    ``weather`` is broadcast: one row per hour of a station, 8,784 a year, whatever the readings.
    """
    return readings.join(F.broadcast(weather), hour, "left")


def attach_dimension(
    readings: DataFrame,
    sensors: DataFrame,
    on: Sequence[str] = ("sds_sensor", "bme_sensor"),
    columns: Sequence[str] = tuple(SENSOR_DIMENSION_COLUMNS),
) -> DataFrame:
    """Add the dimension columns.

    The default joins by pair.  With ``on=("sds_sensor",)`` the first pair of a dust
    sensor (lowest ``bme_sensor``) serves all its rows, one row per sensor.
    """
    on = list(on)
    extra = [c for c in columns if c not in on]
    if "bme_sensor" not in on and "bme_sensor" in sensors.columns:
        ordered = F.struct("bme_sensor", *[c for c in extra if c != "bme_sensor"])
        sensors = sensors.groupBy(*on).agg(F.min(ordered).alias("_d")).select(*on, "_d.*")
    return readings.join(sensors.select(*on, *extra), on, "inner")


def pressure_altitude(
    meteo_hourly: DataFrame,
    station_hourly: DataFrame,
    station_altitude: float = STATION_ALTITUDE_M,
    key: str = "bme_sensor",
    hour: str = "hour",
) -> DataFrame:
    """Altitude above sea level of every weather sensor, from the pressure difference.

    Per hour the barometric step gives a height; the exact median over the hours
    of a sensor is taken.  Groups are bounded by the number of hours.
    """
    joined = meteo_hourly.join(station_hourly.select(hour, "pres_meteo"), hour, "left")
    step = scalar.altitude_step("pressure", "temperature", "pres_meteo")
    return joined.groupBy(key).agg((F.median(step) + F.lit(station_altitude)).alias("sealevel_alt"))


def attach_elevation(sensors: DataFrame, elevation: DataFrame) -> DataFrame:
    """``surface_alt`` = sea-level altitude minus ground elevation; NULL where unknown."""
    ground = elevation.groupBy("lat", "lon").agg(F.max("elevation").alias("elevation"))
    return (
        sensors.join(ground, ["lat", "lon"], "left")
        .withColumn("surface_alt", scalar.surface_altitude("sealevel_alt", "elevation"))
        .drop("elevation")
    )


def missing_elevation(sensors: DataFrame, elevation: DataFrame) -> DataFrame:
    """Places of sensors that have no ground elevation."""
    return sensors.select("lat", "lon").distinct().join(elevation, ["lat", "lon"], "left_anti")


def unseen_links(links: DataFrame, checked: DataFrame, href: str = "href", name: str = "name") -> DataFrame:
    """Links whose name without the leading day is not among the checked ones."""
    seen = checked.select(text.after_date(name).alias("_suffix")).distinct()
    return links.withColumn("_suffix", text.after_date(href)).join(seen, "_suffix", "left_anti").drop("_suffix")


def of_sensors(df: DataFrame, ids: DataFrame, key: str = "sds_sensor") -> DataFrame:
    """Rows of the listed sensors."""
    return df.join(ids.select(key), key, "left_semi")


def not_of_sensors(df: DataFrame, ids: DataFrame, key: str = "sds_sensor") -> DataFrame:
    """Rows of all other sensors."""
    return df.join(ids.select(key), key, "left_anti")


def append_sources(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, repeated ones included; absent columns become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of rows with equal ``keys`` the least by the other columns in their order, nulls first; rows with a null key all stay.

    Copies are folded where they are read, so that a key with many of them is one row a task in the shuffle.
    """
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    others = [c for c in df.columns if c not in keys]
    if others:
        firsts = df.filter(whole).groupBy(*keys).agg(F.min(F.struct(*others)).alias("least")).select(*keys, "least.*")
    else:
        firsts = df.filter(whole).distinct()
    return firsts.select(df.columns).unionAll(df.filter(~whole))


def map_grid(
    extent: DataFrame, lon_step: float = 0.025, lat_step: float = 0.0125, keep: Sequence[str] = ()
) -> DataFrame:
    """Half-open lon x lat grid over each row ``lon_min, lon_max, lat_min, lat_max`` of ``extent``."""

    def axis(low: str, high: str, step: float):
        n = F.ceil((F.col(high) - F.col(low)) / F.lit(step)).cast("int")
        steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.col(low) + i.cast("double") * F.lit(step))

    return (
        extent.withColumn("lon", F.explode(axis("lon_min", "lon_max", lon_step)))
        .withColumn("lat", F.explode(axis("lat_min", "lat_max", lat_step)))
        .select(*keep, "lon", "lat")
    )
