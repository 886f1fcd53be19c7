"""Weather-station records: quoted ``;`` CSV in local time, plain or gzip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.config import STATION_ZONE
from sensorgrid.functions import scalar
from sensorgrid.operators.resample import backfill_hours
from sensorgrid.schemas import STATION_COLUMNS, STATION_RAW, WEATHER_COLUMNS


def read_station(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Records with ``ts_utc``, columns taken by position.

    Header, preamble and broken lines carry no date in the first column and fall
    out, so downloads with leading comment lines read like stored files.
    """
    raw = (
        spark.read.schema(STATION_RAW)
        .option("sep", ";")
        .option("quote", '"')
        .option("header", "false")
        .option("mode", "PERMISSIVE")
        .option("unescapedQuoteHandling", "STOP_AT_CLOSING_QUOTE")
        .csv(paths)
    )
    return with_utc(raw)


def with_utc(raw: DataFrame, zone: str = STATION_ZONE) -> DataFrame:
    local = scalar.station_time(F.trim(F.col("local_time")))
    return (
        raw.withColumn("ts_local", local)
        .filter(F.col("ts_local").isNotNull())
        .withColumn("ts_utc", scalar.to_utc("ts_local", zone))
    )


def select_weather(records: DataFrame) -> DataFrame:
    """The ten weather columns under their output names, pressure in pascal."""
    return records.select(
        "ts_utc",
        scalar.to_number("T").alias("temp_meteo"),
        scalar.mmhg_to_pa(scalar.to_number("Po")).alias("pres_meteo"),
        scalar.to_number("U").alias("hum_meteo"),
        F.col("DD").alias("wind_direction"),
        scalar.to_number("Ff").alias("wind_speed"),
        F.col("W1").alias("precipitation"),
        F.col("RRR").alias("prec_amount"),
        F.col("tR").alias("prec_time"),
        F.col("VV").alias("visibility"),
        scalar.to_number("Td").alias("dew_point_temp"),
    )


def hourly_weather(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Hourly, back-filled weather in UTC: ``hour`` and the ten weather columns."""
    return backfill_hours(select_weather(read_station(spark, paths)), WEATHER_COLUMNS, ts="ts_utc")


def oldest_first(records: DataFrame) -> DataFrame:
    """Stored columns in time order, as a new download is appended."""
    return records.select("ts_local", *STATION_COLUMNS).orderBy("ts_local").drop("ts_local")
