"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import (
    altitudes,
    dust,
    dust_hourly,
    ground,
    labelled,
    meteo,
    meteo_hourly,
    pairs,
    query,
    readings,
    rounded,
    weather_hourly,
)
from sensorgrid.operators import joins, resample, sampling

DUST = ["P1", "P2"]
METEO = ["pressure", "temperature", "humidity"]
WEATHER_SQL = "round(temp_meteo, 6) AS temp_meteo, round(pres_meteo, 6) AS pres_meteo, " \
    "round(hum_meteo, 6) AS hum_meteo, wind_direction, round(wind_speed, 6) AS wind_speed"


@query("j1_colocated_pairs", "SELECT * FROM pairs", "pairs")
def colocated(spark, sf):
    return pairs(spark, sf)


@query(
    "j2_dust_with_paired_meteo",
    """SELECT p.sds_sensor, p.bme_sensor, d.hour, round(P1, 6) AS P1, round(P2, 6) AS P2, round(pressure, 6) AS pressure,
    round(temperature, 6) AS temperature, round(humidity, 6) AS humidity FROM dust_hourly d
    JOIN pairs p ON p.sds_sensor = d.sds_sensor
    LEFT JOIN meteo_hourly m ON m.bme_sensor = p.bme_sensor AND m.hour = d.hour""",
    "pairs dust_hourly meteo_hourly",
)
def paired_meteo(spark, sf):
    """Gaps of the dust sensor are filled after the join; filled hours of the weather sensor have no values to join."""
    dust_hours = resample.hourly_mean(dust(spark, sf), ["sds_sensor"], DUST, fill=False)
    meteo_hours = resample.hourly_mean(meteo(spark, sf), ["bme_sensor"], METEO, fill=False)
    return rounded(joins.attach_meteo(dust_hours, meteo_hours, pairs(spark, sf), METEO, fill=DUST))


@query(
    "j3_readings_with_station_weather",
    f"SELECT sds_sensor, d.hour, round(P1, 6) AS P1, round(P2, 6) AS P2, {WEATHER_SQL} "
    "FROM dust_hourly d LEFT JOIN weather_hourly w ON d.hour = w.hour",
    "dust_hourly weather_hourly",
)
def station_weather(spark, sf):
    return rounded(joins.attach_weather(dust_hourly(spark, sf), weather_hourly(spark, sf)))


@query(
    "j4_readings_with_sensor_dimension",
    """SELECT d.sds_sensor, p.bme_sensor, d.hour, round(d.P1, 6) AS P1, p.lat, p.lon FROM dust_hourly d
    JOIN (SELECT sds_sensor, min(bme_sensor) AS bme_sensor, any_value(lat) AS lat, any_value(lon) AS lon
    FROM pairs GROUP BY 1) p ON p.sds_sensor = d.sds_sensor""",
    "pairs dust_hourly",
)
def dimension(spark, sf):
    """First-pair form: one dimension row per dust sensor."""
    return rounded(
        joins.attach_dimension(
            dust_hourly(spark, sf).select("sds_sensor", "hour", "P1"), pairs(spark, sf), ["sds_sensor"],
            ["bme_sensor", "lat", "lon"],
        ),
        6, "P1",
    )


@query(
    "j5_pressure_minus_station",
    """SELECT bme_sensor, m.hour, round((pressure - pres_meteo) / 1000.0, 6) AS press_diff
    FROM meteo_hourly m LEFT JOIN weather_hourly w ON m.hour = w.hour""",
    "meteo_hourly weather_hourly",
)
def pressure_difference(spark, sf):
    joined = joins.attach_weather(meteo_hourly(spark, sf), weather_hourly(spark, sf).select("hour", "pres_meteo"))
    return rounded(
        joined.select("bme_sensor", "hour", ((F.col("pressure") - F.col("pres_meteo")) / 1000.0).alias("press_diff"))
    )


@query(
    "j6_surface_altitude",
    """SELECT p.sds_sensor, p.bme_sensor, p.lat, p.lon, round(a.sealevel_alt, 6) AS sealevel_alt,
    round(a.sealevel_alt - g.elevation, 6) AS surface_alt FROM pairs p JOIN altitudes a ON a.bme_sensor = p.bme_sensor
    LEFT JOIN ground g ON g.lat = p.lat AND g.lon = p.lon""",
    "pairs altitudes ground",
)
def surface_altitude(spark, sf):
    sensors = pairs(spark, sf).join(altitudes(spark, sf), "bme_sensor")
    return rounded(joins.attach_elevation(sensors, ground(spark, sf)), 6, "sealevel_alt", "surface_alt")


LINK_NAMES = (
    "links AS (SELECT DISTINCT ts::DATE AS day, strftime(ts, '%Y-%m-%d') || '_' || event_type || '_sensor_' || sensor_id || '.csv' AS href "
    "FROM readings), checked AS (SELECT DISTINCT href AS name FROM links WHERE day < DATE '2024-01-04')"
)


def archive_links(spark, sf):
    """File names of an archive that has one file per sensor, type and day."""
    day = F.to_date("ts")
    name = F.concat_ws("_", day.cast("string"), "event_type", F.lit("sensor"), F.col("sensor_id").cast("string"))
    return readings(spark, sf).select(day.alias("day"), F.concat(name, F.lit(".csv")).alias("href")).distinct()


def checked_links(spark, sf):
    return archive_links(spark, sf).filter(F.col("day") < "2024-01-04").select(F.col("href").alias("name"))


@query(
    "j7_unseen_links",
    f"WITH {LINK_NAMES} SELECT day, href FROM links WHERE substr(href, 11) NOT IN (SELECT substr(name, 11) FROM checked)",
    "readings",
)
def unseen(spark, sf):
    return joins.unseen_links(archive_links(spark, sf), checked_links(spark, sf))


TEN_IDS = """WITH ids AS (SELECT sds_sensor FROM (SELECT DISTINCT sds_sensor FROM labelled)
ORDER BY md5(sds_sensor::VARCHAR || '#42'), sds_sensor LIMIT 10)"""


@query(
    "j8_rows_of_sampled_sensors",
    f"{TEN_IDS} SELECT sds_sensor, timestamp, P1 FROM labelled WHERE sds_sensor IN (SELECT sds_sensor FROM ids)",
    "labelled",
)
def sampled(spark, sf):
    df = labelled(spark, sf).select("sds_sensor", "timestamp", "P1")
    return joins.of_sensors(df, sampling.sampled_ids(df, 10))


@query(
    "j9_rows_of_other_sensors",
    f"{TEN_IDS} SELECT sds_sensor, timestamp, P1 FROM labelled WHERE sds_sensor NOT IN (SELECT sds_sensor FROM ids)",
    "labelled",
)
def held_out(spark, sf):
    df = labelled(spark, sf).select("sds_sensor", "timestamp", "P1")
    return joins.not_of_sensors(df, sampling.sampled_ids(df, 10))


J10_SQL = """
WITH o AS (SELECT sensor_id % 7 AS station_id, ts, value, CASE WHEN value > 20 THEN value END AS gappy
FROM readings WHERE event_type = 'signup'),
g AS (SELECT station_id, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS hour
FROM o GROUP BY 1)
SELECT g.station_id, g.hour, o.value, o.gappy FROM g ASOF JOIN o ON g.station_id = o.station_id AND g.hour <= o.ts
"""


@query("j10_forward_asof_backfill", J10_SQL, "readings")
def backfill(spark, sf):
    """Seven stations; a NULL inside the next observation stays NULL."""
    obs = readings(spark, sf).filter(F.col("event_type") == "signup").select(
        (F.col("sensor_id") % 7).alias("station_id"), "ts", "value",
        F.when(F.col("value") > 20, F.col("value")).alias("gappy"),
    )
    return resample.backfill_hours(obs, ["value", "gappy"], ["station_id"])


@query("j10_station_hourly_weather", f"SELECT hour, {WEATHER_SQL} FROM weather_hourly", "weather_hourly")
def hourly_station(spark, sf):
    return rounded(weather_hourly(spark, sf))


J12_SQL = """
WITH e AS (SELECT timestamp, min(lon) AS lon_min, max(lon) + 0.06 AS lon_max, min(lat) AS lat_min, max(lat) + 0.03 AS lat_max FROM
(SELECT hour AS timestamp, lat, lon FROM dust_hourly d JOIN pairs p ON p.sds_sensor = d.sds_sensor
 WHERE d.P1 IS NOT NULL) GROUP BY 1),
i AS (SELECT e.*, unnest(generate_series(0, ceil((lon_max - lon_min) / 0.025::DOUBLE)::INT - 1)) AS i FROM e),
j AS (SELECT i.*, unnest(generate_series(0, ceil((lat_max - lat_min) / 0.0125::DOUBLE)::INT - 1)) AS j FROM i)
SELECT timestamp, round(lon_min + i::DOUBLE * 0.025::DOUBLE, 6) AS lon, round(lat_min + j::DOUBLE * 0.0125::DOUBLE, 6) AS lat FROM j
"""


@query("j12_map_grid", J12_SQL, "pairs dust_hourly")
def grid(spark, sf):
    """The grid over the sensors that report in each hour."""
    reporting = dust_hourly(spark, sf).filter(F.col("P1").isNotNull()).join(pairs(spark, sf), "sds_sensor")
    extent = reporting.groupBy(F.col("hour").alias("timestamp")).agg(
        F.min("lon").alias("lon_min"), (F.max("lon") + 0.06).alias("lon_max"),
        F.min("lat").alias("lat_min"), (F.max("lat") + 0.03).alias("lat_max"),
    )
    return rounded(joins.map_grid(extent, keep=["timestamp"]))


@query(
    "j6_missing_elevation_places",
    "SELECT DISTINCT p.lat, p.lon FROM pairs p WHERE NOT EXISTS "
    "(SELECT 1 FROM ground g WHERE g.lat = p.lat AND g.lon = p.lon AND g.elevation > 98)",
    "pairs ground",
)
def no_elevation(spark, sf):
    return joins.missing_elevation(pairs(spark, sf), ground(spark, sf).filter(F.col("elevation") > 98))
