"""Sensor dimension and hourly dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import MAP_BOX, Box
from sensorgrid.operators import aggregates, joins, nearest, resample
from sensorgrid.schemas import SENSOR_DIMENSION_COLUMNS, WEATHER_COLUMNS
from sensorgrid.session import stored
from sensorgrid.sources.features import split_features

METEO_VALUES = ["pressure", "temperature", "humidity"]
DUST_VALUES = ["P1", "P2"]


def file_positions(readings: DataFrame, file: str = "file") -> DataFrame:
    """``sensor_id, sensor_type, lat, lon`` of every file, from its second row."""
    return aggregates.sample_position(
        readings, file, "timestamp", ["sensor_id", "sensor_type", "lat", "lon"]
    ).drop(file)


def sensor_dimension(
    dust: DataFrame,
    meteo: DataFrame,
    weather: DataFrame,
    elevation: DataFrame,
    features: DataFrame,
    box: Box = MAP_BOX,
) -> DataFrame:
    """One row per co-located pair with altitudes and nearest map features.

    ``dust`` and ``meteo`` are coerced reading files, ``weather`` is hourly, ``elevation``
    has ``lat, lon, elevation`` and ``features`` is the map feature table.
    """
    place = ["file", "timestamp", "sensor_id", "sensor_type", "lat", "lon"]
    # Both are small and read several times: a row per file, a row per pair.
    positions = stored(file_positions(dust.select(place).unionByName(meteo.select(place))), "positions")
    pairs = stored(joins.pair_colocated(positions), "pairs")
    parks, roads, industrial = split_features(features)
    placed = nearest.attach_nearest(pairs, parks, roads, industrial, box)
    hourly = resample.hourly_mean(
        meteo.withColumnRenamed("sensor_id", "bme_sensor"), ["bme_sensor"], METEO_VALUES, ts="timestamp", fill=False
    )
    # Hours without readings have no pressure and do not move a median.
    altitude = joins.pressure_altitude(hourly, weather)
    sensors = joins.attach_elevation(placed.join(altitude, "bme_sensor", "left"), elevation)
    return sensors.select("bme_sensor", *SENSOR_DIMENSION_COLUMNS)


def hourly_dataset(
    dust: DataFrame, meteo: DataFrame, weather: DataFrame, sensors: DataFrame, ts: str = "timestamp"
) -> DataFrame:
    """Sensor x hour facts: dust, paired weather sensor, dimension, station weather.

    Readings are reduced to hours before the first join, and gaps are filled after the
    last shuffle.  ``dust`` has ``sds_sensor``, ``meteo`` has ``bme_sensor``.
    """
    dust_hourly = resample.hourly_mean(dust, ["sds_sensor"], DUST_VALUES, ts, fill=False)
    meteo_hourly = resample.hourly_mean(meteo, ["bme_sensor"], METEO_VALUES, ts, fill=False)
    described = [c for c in SENSOR_DIMENSION_COLUMNS if c != "sds_sensor"]
    facts = joins.attach_meteo(dust_hourly, meteo_hourly, sensors, pair_columns=described, fill=DUST_VALUES)
    weather_columns = [c for c in WEATHER_COLUMNS if c in weather.columns]
    facts = joins.attach_weather(facts, weather.select("hour", *weather_columns))
    return facts.select(
        F.col("hour").alias("timestamp"), *DUST_VALUES, *METEO_VALUES, "bme_sensor", *SENSOR_DIMENSION_COLUMNS, *weather_columns
    )

