"""Declared schemas.  Raw files are read as strings and coerced, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# --- fixed values: column names of the published files ----------------------------
SDS_COLUMNS = [
    "sensor_id", "sensor_type", "location", "lat", "lon", "timestamp",
    "P1", "durP1", "ratioP1", "P2", "durP2", "ratioP2",
]
BME_COLUMNS = [
    "sensor_id", "sensor_type", "location", "lat", "lon", "timestamp",
    "pressure", "altitude", "pressure_sealevel", "temperature", "humidity",
]
STATION_COLUMNS = [
    "local_time", "T", "Po", "P", "Pa", "U", "DD", "Ff", "ff10", "ff3", "N", "WW", "W1", "W2",
    "Tn", "Tx", "Cl", "Nh", "H", "Cm", "Ch", "VV", "Td", "RRR", "tR", "E", "Tg", "E_snow", "sss",
]
WEATHER_COLUMNS = [
    "temp_meteo", "pres_meteo", "hum_meteo", "wind_direction", "wind_speed",
    "precipitation", "prec_amount", "prec_time", "visibility", "dew_point_temp",
]
SENSOR_DIMENSION_COLUMNS = [
    "sds_sensor", "lat", "lon", "sealevel_alt", "surface_alt",
    "nearest_park", "nearest_road", "nearest_indust",
]
# -----------------------------------------------------------------------------

SDS_RAW = _strings(SDS_COLUMNS)
BME_RAW = _strings(BME_COLUMNS)
STATION_RAW = _strings(STATION_COLUMNS)

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
#: A relation's rings and lines; ``role`` is ``inner`` for a hole, anything else adds to the feature.
RINGS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("ring", T.ArrayType(POINT))]))
FEATURES = T.StructType(
    [
        T.StructField("feature_id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ring", T.ArrayType(POINT)),
    ]
)
#: Features of which some are relations: one with ``rings`` is made of these, and its ``ring`` is not used.
RELATIONS = T.StructType([*FEATURES.fields, T.StructField("rings", RINGS)])
ELEVATION_RESPONSE = (
    "results array<struct<elevation:double,location:struct<lat:double,lng:double>>>, status string"
)


def require_columns(df, names) -> None:
    """Raise ``AttributeError`` when a needed column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise AttributeError(f"missing columns: {', '.join(missing)}")
