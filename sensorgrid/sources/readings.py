"""Sensor reading files: ``;``-separated, one header line per file.

All files of a sensor type are read in one scan with a declared string schema and
then coerced.  Empty and header-only files give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorgrid.functions import scalar, text
from sensorgrid.schemas import BME_RAW, SDS_RAW

TEXT_COLUMNS = ("sensor_type",)
ID_COLUMNS = ("sensor_id", "location")
FILE_NAME = "file"
# Settings shared by the batch and the stream reader.
CSV_OPTIONS = {
    "sep": ";",
    "header": "true",
    "mode": "PERMISSIVE",
    "enforceSchema": "true",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def coerce(raw: DataFrame, numbers_only: bool = False) -> DataFrame:
    """Timestamps and numbers from text; what does not parse is NULL.

    ``numbers_only`` turns the text columns into (all NULL) numbers as well.
    """

    def column(f: T.StructField):
        if f.name == "timestamp":
            return scalar.to_time(f.name).alias(f.name)
        if f.name == FILE_NAME or (f.name in TEXT_COLUMNS and not numbers_only):
            return F.col(f.name)
        if f.name in ID_COLUMNS:
            return F.col(f.name).try_cast("bigint").alias(f.name)
        return scalar.to_number(f.name).alias(f.name)

    return raw.select(*[column(f) for f in raw.schema.fields])


def read_raw(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """String columns of all files, with the file name of each row."""
    return (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS)
        .csv(paths)
        .withColumn(FILE_NAME, F.col("_metadata.file_name"))
    )


def with_file_sensor(df: DataFrame) -> DataFrame:
    """Add the sensor id and type that the file name states."""
    named = text.stored_file_sensor(FILE_NAME)
    return df.withColumns({"file_sensor_id": named["sensor_id"], "file_sensor_type": named["sensor_type"]})


def read_dust(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return with_file_sensor(coerce(read_raw(spark, paths, SDS_RAW)))


def read_meteo(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return with_file_sensor(coerce(read_raw(spark, paths, BME_RAW)))


def stream_raw(spark: SparkSession, folder: str, schema: T.StructType, **options: str) -> DataFrame:
    """The same rows from files as they arrive in ``folder``."""
    return (
        spark.readStream.schema(schema)
        .options(**CSV_OPTIONS, **options)
        .csv(folder)
        .withColumn(FILE_NAME, F.col("_metadata.file_name"))
    )
