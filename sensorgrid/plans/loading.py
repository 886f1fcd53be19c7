"""Which sensor files are still to be loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import ARCHIVE_URL, DEFAULT_LOAD_DAYS
from sensorgrid.functions import scalar, text
from sensorgrid.operators import aggregates


def listed_sensors(lines: DataFrame, column: str = "value") -> DataFrame:
    """``sensor_id, sensor_type`` from list lines such as ``_sds011_sensor_123.csv``."""
    return lines.select(text.archive_file_sensor(column).alias("_s")).select("_s.*").na.drop().distinct()


def load_plan(sensors: DataFrame, stored: DataFrame, today: Column, server: str = ARCHIVE_URL,
              days: int | None = DEFAULT_LOAD_DAYS) -> DataFrame:
    """``sensor_id, sensor_type, day, url, file`` of every missing sensor day.

    A sensor starts at the day after its last stored row, but not more than ``days`` back (30 in
    the reference), and ends yesterday.  With ``days`` None it starts after its last stored row however
    far back that is; only a sensor without stored rows then starts 30 days back.  ``stored`` has ``sensor_id, timestamp`` and, where one id has
    files of several types, ``sensor_type``.
    """
    default_day = aggregates.default_load_day(today, DEFAULT_LOAD_DAYS if days is None else days)
    key = ["sensor_id", "sensor_type"] if "sensor_type" in stored.columns else ["sensor_id"]
    marks = aggregates.high_water(stored, key)
    marked = sensors.join(marks, key, "left")
    if days is None:
        start = marked.withColumn("start_day", F.coalesce("next_day", default_day))
    else:
        start = aggregates.load_start(marked, default_day)
    missing = start.select(
        "sensor_id", "sensor_type", F.explode(scalar.days_between("start_day", F.date_sub(today, 1))).alias("day")
    )
    return missing.withColumns(
        {
            "url": text.archive_url("sensor_id", "day", "sensor_type", server),
            "file": text.stored_file_name("sensor_id", "sensor_type"),
        }
    )


def station_load_interval(records: DataFrame, today: Column, first_day: str = "2019-04-01") -> DataFrame:
    """One row ``start_day, end_day`` of missing station days; no row when up to date."""
    last = records.agg(F.max("ts_local").alias("last"))
    return last.select(
        F.coalesce(F.date_add(F.to_date("last"), 1), F.lit(first_day).cast("date")).alias("start_day"),
        F.date_sub(today, 1).alias("end_day"),
    ).filter(F.col("start_day") < F.col("end_day"))
