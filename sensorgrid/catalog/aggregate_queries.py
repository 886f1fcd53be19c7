"""Resampling and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorgrid.catalog.base import altitudes, dust, dust_hourly, labelled, query, readings, rounded, weather_hourly
from sensorgrid.operators import aggregates, resample, spectral
from sensorgrid.operators.select import sensor_series

A1_SQL = """
WITH h AS (SELECT sensor_id, date_trunc('hour', ts) AS hour, avg(value) AS value FROM readings GROUP BY 1, 2),
g AS (SELECT sensor_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1)
SELECT g.sensor_id, g.hour, round(h.value, 6) AS value
FROM g LEFT JOIN h ON g.sensor_id = h.sensor_id AND g.hour = h.hour
"""


@query("a1_hourly_mean_grid", A1_SQL, "readings")
def hourly_mean_grid(spark, sf):
    return rounded(resample.hourly_mean(readings(spark, sf), ["sensor_id"], ["value"]))


@query(
    "a2_pressure_altitude",
    "SELECT bme_sensor, round(sealevel_alt, 6) AS sealevel_alt FROM altitudes",
    "altitudes",
)
def pressure_altitude(spark, sf):
    return rounded(altitudes(spark, sf))


@query(
    "a3_city_mean",
    "SELECT hour, round(avg(P1), 8) AS P1, round(avg(P2), 8) AS P2 FROM dust_hourly GROUP BY 1",
    "dust_hourly",
)
def city_mean(spark, sf):
    return rounded(aggregates.city_mean(dust_hourly(spark, sf), "hour", ["P1", "P2"]), 8)


@query(
    "a4_last_known_values",
    """SELECT sds_sensor, arg_max(lat, timestamp) AS lat, arg_max(lon, timestamp) AS lon,
    arg_max(P1, timestamp) FILTER (WHERE P1 IS NOT NULL) AS P1 FROM
    (SELECT timestamp, lat, lon, sds_sensor, CASE WHEN P1 > 5 THEN P1 END AS P1 FROM labelled) GROUP BY 1""",
    "labelled",
)
def last_known(spark, sf):
    """Last position and last value over 5 per sensor; smaller values are set to NULL first."""
    df = labelled(spark, sf).withColumn("P1", F.when(F.col("P1") > 5, F.col("P1")))
    return aggregates.last_known(df, ["lat", "lon", "P1"])


@query(
    "a5_sensor_series",
    "SELECT sds_sensor, timestamp, P1, row_number() OVER (PARTITION BY sds_sensor ORDER BY timestamp) AS place FROM labelled",
    "labelled",
)
def series(spark, sf):
    """Each row with its place in the series of its sensor, as the rows lie in the output."""
    laid = sensor_series(labelled(spark, sf), "P1").withColumn("_at", F.monotonically_increasing_id())
    return laid.withColumn("place", F.row_number().over(Window.partitionBy("sds_sensor").orderBy("_at"))).drop("_at")


CORR_COLUMNS = ["P1", "temp_meteo", "pres_meteo", "wind_speed"]


def _corr_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM j"
        for a in CORR_COLUMNS
        for b in CORR_COLUMNS
    )
    return (
        "WITH j AS (SELECT ln(CASE WHEN d.P1 > 0 THEN d.P1 END) AS P1, w.temp_meteo, w.pres_meteo + d.P2 AS pres_meteo, w.wind_speed * w.wind_speed AS wind_speed "
        "FROM dust_hourly d LEFT JOIN weather_hourly w ON d.hour = w.hour) " + parts
    )


@query("a8_log_correlation_matrix", _corr_sql(), "dust_hourly weather_hourly")
def correlation(spark, sf):
    j = dust_hourly(spark, sf).join(weather_hourly(spark, sf), "hour", "left").withColumns(
        {"pres_meteo": F.col("pres_meteo") + F.col("P2"), "wind_speed": F.col("wind_speed") * F.col("wind_speed")}
    )
    return rounded(aggregates.log_correlation(j, CORR_COLUMNS[1:]))


@query(
    "a9_fit_log_target",
    "SELECT round(avg(ln(CASE WHEN P1 > 0 THEN P1 END)), 6) AS mean, round(stddev_pop(ln(CASE WHEN P1 > 0 THEN P1 END)), 6) AS sd, min(timestamp) AS start FROM labelled",
    "labelled",
)
def fit_target(spark, sf):
    return rounded(aggregates.fit_target(labelled(spark, sf)))


A10_SQL = """
WITH r AS (SELECT sensor_id, ts, value, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, value) AS rn FROM readings)
SELECT sensor_id, arg_max(ts, rn) AS ts, arg_max(value, rn) AS value FROM r WHERE rn <= 2 GROUP BY 1
"""


@query("a10_second_row_per_file", A10_SQL, "readings")
def second_row(spark, sf):
    df = readings(spark, sf).withColumn("at", F.col("ts"))
    return aggregates.sample_position(df, "sensor_id", "at", ["ts", "value"])


@query(
    "a11_high_water_mark",
    "SELECT sensor_id, (max(ts)::DATE + 1)::DATE AS next_day FROM readings GROUP BY 1",
    "readings",
)
def high_water(spark, sf):
    return aggregates.high_water(readings(spark, sf), "sensor_id", "ts")


@query(
    "a12_sample_size",
    "SELECT round_even(count(DISTINCT sds_sensor) * 0.25::DOUBLE, 0)::BIGINT AS n FROM dust",
    "dust",
)
def sample_size(spark, sf):
    return aggregates.sample_size(dust(spark, sf))


@query("a13_sensor_ids", "SELECT DISTINCT sds_sensor FROM dust", "dust")
def sensor_ids(spark, sf):
    return aggregates.sensor_ids(dust(spark, sf))


CITY_SQL = """
WITH c AS (SELECT hour, avg(P1) AS y FROM dust_hourly GROUP BY 1 HAVING avg(P1) IS NOT NULL),
s AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS t, y - (SELECT avg(y) FROM c) AS y, (SELECT count(*) FROM c) AS n FROM c)
"""


def _city_series(spark, sf):
    city = aggregates.city_mean(dust_hourly(spark, sf), "hour", ["P1"])
    return spectral.indexed_series(city, "P1", "hour")


@query(
    "a15_autocovariance",
    CITY_SQL.strip()
    + """, l AS (SELECT unnest(generate_series(0, (SELECT max(t) FROM s))) AS lag)
SELECT l.lag, round(sum(a.y * b.y) / max(a.n), 6) AS acov FROM s a CROSS JOIN l JOIN s b ON b.t = a.t + l.lag GROUP BY 1""",
    "dust_hourly",
)
def autocovariance(spark, sf):
    return rounded(spectral.autocovariance(_city_series(spark, sf)))


@query(
    "a16_periodogram",
    CITY_SQL.strip()
    + """, f AS (SELECT unnest(generate_series(0, (SELECT count(*) // 2 FROM s))) AS k)
SELECT f.k, round(f.k / max(s.n)::DOUBLE, 9) AS freq,
round((pow(sum(s.y * cos(2 * pi() * ((f.k * s.t) % s.n) / s.n)), 2) + pow(sum(s.y * sin(2 * pi() * ((f.k * s.t) % s.n) / s.n)), 2))
/ max(s.n) * CASE WHEN f.k = 0 OR 2 * f.k = max(s.n) THEN 1 ELSE 2 END, 4) AS power
FROM s CROSS JOIN f GROUP BY f.k""",
    "dust_hourly",
)
def periodogram(spark, sf):
    out = spectral.periodogram(_city_series(spark, sf))
    return rounded(rounded(out, 9, "freq"), 4, "power")
