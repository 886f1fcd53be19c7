"""Query registry and the views that turn the driver's tables into sensor data.

``events`` plays the readings: clicks and views are dust readings, purchases and errors
come from weather sensors, signups are station records.  Every view is defined
twice with one meaning, as a DataFrame here and as a CTE for the oracle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorgrid.operators.joins import pair_colocated, pressure_altitude
from sensorgrid.operators.resample import backfill_hours, hourly_mean
from sensorgrid.session import apply_runtime_conf

METEO_ID_BASE = 1_000_000
WEATHER = ["temp_meteo", "pres_meteo", "hum_meteo", "wind_direction", "wind_speed"]


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(spark, sf_dir)``; ``ctes`` names the views the oracle needs."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(fn(apply_runtime_conf(spark), sf_dir))

        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Entry(run, with_views(ctes, sql) if sql else None)
        return fn

    return register


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in REGISTRY.items()}


def registered_oracles() -> dict[str, str]:
    return {name: e.sql for name, e in REGISTRY.items() if e.sql}


def comparable(df: DataFrame) -> DataFrame:
    """Timestamps without zone, whole numbers as bigint."""
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def rounded(df: DataFrame, digits: int = 6, *only: str) -> DataFrame:
    """Round the double columns."""
    names = only or tuple(f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType))
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- views -------------------------------------------------------------------------
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.col("user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"
    )


def dust(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).filter(F.col("event_type").isin("click", "view")).select(
        F.col("sensor_id").alias("sds_sensor"), "ts", F.col("value").alias("P1"), (F.col("value") / 3).alias("P2")
    )


def meteo(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).filter(F.col("event_type").isin("purchase", "error")).select(
        (F.col("sensor_id") + METEO_ID_BASE).alias("bme_sensor"),
        "ts",
        (F.lit(98000.0) + F.col("value") * 10).alias("pressure"),
        (F.col("value") / 10).alias("temperature"),
        (F.lit(100.0) - F.col("value") / 10).alias("humidity"),
    )


def station(spark: SparkSession, sf: str) -> DataFrame:
    return readings(spark, sf).filter(F.col("event_type") == "signup").select(
        "ts",
        (F.col("value") / 10).alias("temp_meteo"),
        (F.lit(99000.0) + F.col("value") * 10).alias("pres_meteo"),
        (F.lit(100.0) - F.col("value") / 10).alias("hum_meteo"),
        F.concat(F.lit("W"), (F.col("sensor_id") % 8).cast("string")).alias("wind_direction"),
        (F.col("value") / 20).alias("wind_speed"),
    )


def place_lat(place: Column) -> Column:
    return F.lit(55.26) + (place * 37 % 12100) / F.lit(10000.0)


def place_lon(place: Column) -> Column:
    return F.lit(36.82) + (place * 53 % 15800) / F.lit(10000.0)


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per sensor; two neighbouring users share a place."""
    place = F.floor(F.col("sensor_id") / 2).cast("bigint")
    kind = F.when(F.col("event_type").isin("click", "view"), "SDS011").when(
        F.col("event_type").isin("purchase", "error"), "BME280"
    )
    return (
        readings(spark, sf)
        .select("sensor_id", kind.alias("sensor_type"))
        .filter(F.col("sensor_type").isNotNull())
        .distinct()
        .select(
            F.when(F.col("sensor_type") == "SDS011", F.col("sensor_id"))
            .otherwise(F.col("sensor_id") + METEO_ID_BASE)
            .alias("sensor_id"),
            "sensor_type",
            place_lat(place).alias("lat"),
            place_lon(place).alias("lon"),
        )
    )


def dust_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_mean(dust(spark, sf), ["sds_sensor"], ["P1", "P2"])


def meteo_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return hourly_mean(meteo(spark, sf), ["bme_sensor"], ["pressure", "temperature", "humidity"])


def weather_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return backfill_hours(station(spark, sf), WEATHER)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pair_colocated(positions(spark, sf))


def ground(spark: SparkSession, sf: str) -> DataFrame:
    """Elevation of the places, from the JSON property of the readings."""
    k = F.from_json("props", "k double")["k"]
    place = F.floor(F.col("user_id") / 2).cast("bigint")
    return (
        events(spark, sf)
        .groupBy(place_lat(place).alias("lat"), place_lon(place).alias("lon"))
        .agg(F.max(k).alias("elevation"))
    )


def altitudes(spark: SparkSession, sf: str) -> DataFrame:
    """Hours without readings have no pressure and do not move a median, so they are not filled in."""
    hours = hourly_mean(meteo(spark, sf), ["bme_sensor"], ["pressure", "temperature", "humidity"], fill=False)
    return pressure_altitude(hours, weather_hourly(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Dust readings with place, under the role names of the study."""
    place = F.floor(F.col("sds_sensor") / 2).cast("bigint")
    return dust(spark, sf).select(
        F.col("ts").alias("timestamp"),
        place_lat(place).alias("lat"),
        place_lon(place).alias("lon"),
        "sds_sensor",
        "P1",
        "P2",
    )


# --- the same views for the oracle, in dependency order --------------------------------
_PLACE = (
    "55.26::DOUBLE + (({p}) * 37 % 12100) / 10000.0::DOUBLE AS lat, "
    "36.82::DOUBLE + (({p}) * 53 % 15800) / 10000.0::DOUBLE AS lon"
)


def place_sql(place: str) -> str:
    return _PLACE.format(p=place)


def _grid_sql(name: str, source: str, key: str, values: list[str]) -> dict[str, str]:
    avg = ", ".join(f"avg({v}) AS {v}" for v in values)
    cols = ", ".join(f"h.{v}" for v in values)
    return {
        f"{name}_h": f"SELECT {key}, date_trunc('hour', ts) AS hour, {avg} FROM {source} GROUP BY 1, 2",
        f"{name}_g": f"SELECT {key}, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour "
        f"FROM {name}_h GROUP BY 1",
        f"{name}_hourly": f"SELECT g.{key}, g.hour, {cols} FROM {name}_g g "
        f"LEFT JOIN {name}_h h ON g.{key} = h.{key} AND g.hour = h.hour",
    }


VIEWS: dict[str, str] = {
    "readings": "SELECT user_id AS sensor_id, ts, event_type, value FROM events",
    "dust": "SELECT user_id AS sds_sensor, ts, value AS P1, value / 3 AS P2 FROM events "
    "WHERE event_type IN ('click', 'view')",
    "meteo": f"SELECT user_id + {METEO_ID_BASE} AS bme_sensor, ts, 98000.0 + value * 10 AS pressure, "
    "value / 10 AS temperature, 100.0 - value / 10 AS humidity FROM events "
    "WHERE event_type IN ('purchase', 'error')",
    "station": "SELECT ts, value / 10 AS temp_meteo, 99000.0 + value * 10 AS pres_meteo, "
    "100.0 - value / 10 AS hum_meteo, 'W' || (user_id % 8)::VARCHAR AS wind_direction, "
    "value / 20 AS wind_speed FROM events WHERE event_type = 'signup'",
    "positions": "SELECT sensor_id + CASE WHEN sensor_type = 'SDS011' THEN 0 ELSE "
    f"{METEO_ID_BASE} END AS sensor_id, sensor_type, {place_sql('sensor_id // 2')} FROM ("
    "SELECT DISTINCT user_id AS sensor_id, CASE WHEN event_type IN ('click', 'view') THEN 'SDS011' "
    "WHEN event_type IN ('purchase', 'error') THEN 'BME280' END AS sensor_type FROM events) "
    "WHERE sensor_type IS NOT NULL",
    **_grid_sql("dust", "dust", "sds_sensor", ["P1", "P2"]),
    **_grid_sql("meteo", "meteo", "bme_sensor", ["pressure", "temperature", "humidity"]),
    "weather_g": "SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), "
    "INTERVAL 1 HOUR)) AS hour FROM station",
    "weather_hourly": "SELECT g.hour, o.* EXCLUDE (ts) FROM weather_g g ASOF JOIN station o ON g.hour <= o.ts",
    "pairs": "SELECT s.sensor_id AS sds_sensor, b.sensor_id AS bme_sensor, s.lat, s.lon FROM positions s "
    "JOIN positions b ON s.lat = b.lat AND s.lon = b.lon "
    "WHERE s.sensor_type = 'SDS011' AND b.sensor_type = 'BME280'",
    "ground": f"SELECT lat, lon, max(k) AS elevation FROM (SELECT {place_sql('user_id // 2')}, "
    "(props->>'k')::DOUBLE AS k FROM events) GROUP BY lat, lon",
    "altitudes": "SELECT m.bme_sensor, median(-(8000.0 / (m.pressure / 1000.0) * (1.0 + 0.00366 * m.temperature)) "
    "* ((m.pressure - w.pres_meteo) / 1000.0)) + 125.0 AS sealevel_alt FROM meteo_hourly m "
    "LEFT JOIN weather_hourly w ON m.hour = w.hour GROUP BY 1",
    "labelled": f"SELECT ts AS timestamp, {place_sql('sds_sensor // 2')}, sds_sensor, P1, P2 FROM dust",
}

_NEEDS = {
    "dust_hourly": ["dust", "dust_h", "dust_g"],
    "meteo_hourly": ["meteo", "meteo_h", "meteo_g"],
    "weather_hourly": ["station", "weather_g"],
    "pairs": ["positions"],
    "altitudes": ["meteo_hourly", "weather_hourly"],
    "labelled": ["dust"],
}


def with_views(names: str, sql: str) -> str:
    """Put the named views and what they need in front of ``sql``."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            add(dep)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    if not wanted:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    return f"WITH {ctes},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {ctes}\n{body}"
