"""User-level jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import (
    METEO_ID_BASE,
    altitudes,
    dust,
    dust_hourly,
    events,
    ground,
    meteo,
    pairs,
    place_lat,
    place_lon,
    place_sql,
    query,
    readings,
    rounded,
    station,
    weather_hourly,
)
from sensorgrid.catalog.geo_queries import J11_SQL, shapes
from sensorgrid.catalog.join_queries import LINK_NAMES, WEATHER_SQL, archive_links, checked_links
from sensorgrid.config import StudyPeriod
from sensorgrid.plans import dataset, discovery, loading, studies
from sensorgrid.session import stored

DIMENSION = ["sealevel_alt", "surface_alt", "nearest_park", "nearest_road", "nearest_indust"]


def file_rows(spark, sf, kinds, sensor_type, base, **values):
    """Reading files by sensor: ``file, timestamp, sensor_id, sensor_type, lat, lon`` and values."""
    place = F.floor(F.col("sensor_id") / 2).cast("bigint")
    return readings(spark, sf).filter(F.col("event_type").isin(*kinds)).select(
        F.concat_ws("_", (F.col("sensor_id") + base).cast("string"), F.lit(sensor_type.lower()), F.lit("sensor"), F.lit(".csv")).alias("file"),
        F.col("ts").alias("timestamp"),
        (F.col("sensor_id") + base).alias("sensor_id"),
        F.lit(sensor_type).alias("sensor_type"),
        place_lat(place).alias("lat"),
        place_lon(place).alias("lon"),
        *[c.alias(n) for n, c in values.items()],
    )


def dust_files(spark, sf):
    return file_rows(spark, sf, ["click", "view"], "SDS011", 0, P1=F.col("value"), P2=F.col("value") / 3)


def meteo_files(spark, sf):
    return file_rows(
        spark, sf, ["purchase", "error"], "BME280", METEO_ID_BASE, pressure=F.lit(98000.0) + F.col("value") * 10,
        temperature=F.col("value") / 10, humidity=F.lit(100.0) - F.col("value") / 10,
    )


def sensors(spark, sf):
    return dataset.sensor_dimension(
        dust_files(spark, sf), meteo_files(spark, sf), weather_hourly(spark, sf), ground(spark, sf), shapes(spark, sf)
    )


P1_SQL = f"""
SELECT n.sds_sensor, n.bme_sensor, n.lat, n.lon, round(a.sealevel_alt, 6) AS sealevel_alt, round(a.sealevel_alt - g.elevation, 6) AS surface_alt,
n.nearest_park, n.nearest_road, n.nearest_indust FROM ({J11_SQL}) n LEFT JOIN altitudes a ON a.bme_sensor = n.bme_sensor
LEFT JOIN ground g ON g.lat = n.lat AND g.lon = n.lon
"""


@query("p1_sensor_dimension", P1_SQL, "pairs altitudes ground")
def sensor_dimension(spark, sf):
    out = rounded(sensors(spark, sf), 4, "nearest_park", "nearest_road", "nearest_indust")
    return rounded(out, 6, "sealevel_alt", "surface_alt")


P2_SQL = f"""
SELECT d.hour AS timestamp, round(d.P1, 6) AS P1, round(d.P2, 6) AS P2, round(m.pressure, 6) AS pressure, round(m.temperature, 6) AS temperature,
round(m.humidity, 6) AS humidity, p.bme_sensor, p.sds_sensor, p.lat, p.lon, round(a.sealevel_alt, 6) AS sealevel_alt,
round(a.sealevel_alt - g.elevation, 6) AS surface_alt, {WEATHER_SQL}
FROM dust_hourly d JOIN pairs p ON p.sds_sensor = d.sds_sensor
LEFT JOIN meteo_hourly m ON m.bme_sensor = p.bme_sensor AND m.hour = d.hour
LEFT JOIN altitudes a ON a.bme_sensor = p.bme_sensor LEFT JOIN ground g ON g.lat = p.lat AND g.lon = p.lon
LEFT JOIN weather_hourly w ON w.hour = d.hour
"""


@query("p2_hourly_dataset", P2_SQL, "dust_hourly meteo_hourly weather_hourly pairs altitudes ground")
def hourly_dataset(spark, sf):
    """All pairs; map features are left out here and covered by the dimension query."""
    from sensorgrid.operators import joins

    dimension = joins.attach_elevation(pairs(spark, sf).join(altitudes(spark, sf), "bme_sensor", "left"), ground(spark, sf))
    blank = F.lit(None).cast("double")
    # The dimension is built once and kept as a table, as a user would.
    dimension = stored(dimension.withColumns({c: blank for c in ("nearest_park", "nearest_road", "nearest_indust")}), "sensors")
    out = dataset.hourly_dataset(dust(spark, sf), meteo(spark, sf), weather_hourly(spark, sf), dimension, "ts")
    out = out.drop("nearest_park", "nearest_road", "nearest_indust")
    return rounded(out, 6, *[c for c, t in out.dtypes if t == "double" and c not in ("lat", "lon")])


LISTED = """
WITH {links},
fresh AS (SELECT day, href FROM links WHERE substr(href, 11) NOT IN (SELECT substr(name, 11) FROM checked)
AND day < DATE '2024-01-20' AND day >= DATE '2024-01-11'),
latest AS (SELECT day, href FROM fresh WHERE day = (SELECT max(day) FROM fresh))
"""


def _listings(spark, sf):
    """One listing page per day and sensor type."""
    anchor = F.concat(F.lit('<tr><td><a href="'), "href", F.lit('">file</a></td></tr>'))
    return archive_links(spark, sf).select("day", anchor.alias("html"))


def _new(spark, sf):
    links = discovery.new_links(_listings(spark, sf), checked_links(spark, sf))
    return discovery.latest_new_links(links, F.lit("2024-01-20").cast("date"))


@query(
    "p3_new_links",
    LISTED.format(links=LINK_NAMES)
    + "SELECT day, href, 'https://archive.sensor.community/' || day::VARCHAR || '/' || href AS url FROM latest",
    "readings",
)
def new_links(spark, sf):
    return _new(spark, sf)


@query(
    "p3_discovered_sensors",
    LISTED.format(links=LINK_NAMES)
    + f""", f AS (SELECT strftime(ts, '%Y-%m-%d') || '_' || event_type || '_sensor_' || sensor_id || '.csv' AS href, ts,
    CASE WHEN sensor_id % 4 = 0 THEN NULL ELSE lat - 0.05::DOUBLE + (sensor_id % 7) / 5.0::DOUBLE END AS lat, lon
    FROM (SELECT *, {place_sql('sensor_id // 2')} FROM readings)),
    r AS (SELECT href, arg_min(lat, ts) AS lat, arg_min(lon, ts) AS lon FROM (SELECT href, ts, coalesce(lat, -1) AS lat, lon FROM f) GROUP BY 1)
    SELECT substr(l.href, 11) AS sensor FROM latest l JOIN r ON r.href = l.href
    WHERE lat BETWEEN 55.26::DOUBLE AND 56.47::DOUBLE AND lon BETWEEN 36.82::DOUBLE AND 38.40::DOUBLE""",
    "readings",
)
def discovered(spark, sf):
    """A quarter of the files has an unreadable latitude."""
    place = F.floor(F.col("sensor_id") / 2).cast("bigint")
    name = F.concat_ws("_", F.to_date("ts").cast("string"), "event_type", F.lit("sensor"), F.col("sensor_id").cast("string"))
    lat = place_lat(place) - F.lit(0.05) + (F.col("sensor_id") % 7) / F.lit(5.0)
    rows = readings(spark, sf).select(
        F.concat(name, F.lit(".csv")).alias("file"),
        F.col("ts").alias("timestamp"),
        F.when(F.col("sensor_id") % 4 == 0, "n/a").otherwise(lat.cast("string")).alias("lat"),
        place_lon(place).cast("string").alias("lon"),
    )
    return discovery.discover(_new(spark, sf), rows).accepted


P4_SQL = """
WITH s AS (SELECT DISTINCT user_id AS sensor_id, event_type AS sensor_type FROM events),
h AS (SELECT user_id AS sensor_id, max(ts)::DATE + 1 AS next_day FROM events WHERE event_type = 'click' GROUP BY 1),
d AS (SELECT s.*, unnest(generate_series(greatest(DATE '2024-01-03', coalesce(next_day, DATE '2024-01-03')), DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day
FROM s LEFT JOIN h ON h.sensor_id = s.sensor_id)
SELECT sensor_id, sensor_type, day, 'https://archive.sensor.community/' || day::VARCHAR || '/' || day::VARCHAR || '_' || sensor_type || '_sensor_' ||
sensor_id || '.csv' AS url, sensor_id || '_' || sensor_type || '_sensor_.csv' AS file FROM d
"""


@query("p4_load_plan", P4_SQL)
def load_plan(spark, sf):
    e = events(spark, sf)
    lines = e.select(
        F.concat(F.lit("_"), "event_type", F.lit("_sensor_"), F.col("user_id").cast("string"), F.lit(".csv")).alias("value")
    )
    stored = e.filter(F.col("event_type") == "click").select(F.col("user_id").alias("sensor_id"), F.col("ts").alias("timestamp"))
    return loading.load_plan(loading.listed_sensors(lines), stored, F.lit("2024-02-02").cast("date"))


@query(
    "p4_station_load_interval",
    "SELECT max(ts)::DATE + 1 AS start_day, DATE '2024-02-19' AS end_day FROM station HAVING max(ts)::DATE + 1 < DATE '2024-02-19'",
    "station",
)
def station_interval(spark, sf):
    """Days of the station that are still to be loaded."""
    return loading.station_load_interval(station(spark, sf).select(F.col("ts").alias("ts_local")), F.lit("2024-02-20").cast("date"))


def _study_frame(spark, sf):
    from sensorgrid.operators import joins

    facts = joins.attach_weather(dust_hourly(spark, sf), weather_hourly(spark, sf))
    return facts.join(altitudes(spark, sf).withColumn("sds_sensor", F.col("bme_sensor") - METEO_ID_BASE), "sds_sensor").withColumn(
        "pres_meteo", F.col("pres_meteo") + F.col("P2")
    )


STUDY_CTE = f"""
WITH j AS (SELECT d.hour AS timestamp, ln(CASE WHEN d.P1 > 0 THEN d.P1 END) AS P1, w.temp_meteo, w.pres_meteo + d.P2 AS pres_meteo, w.hum_meteo, w.wind_speed, a.sealevel_alt
FROM dust_hourly d LEFT JOIN weather_hourly w ON d.hour = w.hour JOIN altitudes a ON a.bme_sensor = d.sds_sensor + {METEO_ID_BASE})
"""


def _study_sql() -> str:
    groups = {"weather": ["temp_meteo", "pres_meteo", "hum_meteo", "wind_speed", "P1"], "space": ["sealevel_alt", "P1"]}
    parts = [
        f"SELECT '{g}' AS \"group\", '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM j"
        for g, cols in groups.items() for a in cols for b in cols
    ]
    return STUDY_CTE + " UNION ALL ".join(parts)


@query("p5_feature_correlations", _study_sql(), "dust_hourly weather_hourly altitudes")
def correlations(spark, sf):
    return rounded(studies.feature_correlations(_study_frame(spark, sf)))


@query(
    "p5_feature_pairs",
    STUDY_CTE + """SELECT 'temp_meteo' AS feature, round(temp_meteo, 6) AS x, round(P1, 6) AS y FROM j
    UNION ALL SELECT 'sealevel_alt', round(sealevel_alt, 6), round(P1, 6) FROM j""",
    "dust_hourly weather_hourly altitudes",
)
def scatter(spark, sf):
    return rounded(studies.feature_pairs(_study_frame(spark, sf), ["temp_meteo", "sealevel_alt"]))


P6_CTE = """
WITH c AS (SELECT hour, CASE WHEN avg(P1) <= 1 THEN 1 ELSE avg(P1) END AS y FROM dust_hourly
WHERE hour >= TIMESTAMP '2024-01-02' AND hour < TIMESTAMP '2024-01-30' GROUP BY 1 HAVING avg(P1) IS NOT NULL),
z AS (SELECT row_number() OVER (ORDER BY hour) - 1 AS t, (ln(y) - (SELECT avg(ln(y)) FROM c)) / (SELECT stddev_pop(ln(y)) FROM c) AS y FROM c),
s AS (SELECT t, y - (SELECT avg(y) FROM z) AS y, (SELECT count(*) FROM z) AS n FROM z),
l AS (SELECT unnest(generate_series(0, (SELECT max(t) FROM s))) AS lag),
g AS (SELECT l.lag, sum(a.y * b.y) / max(a.n) AS acov FROM s a CROSS JOIN l JOIN s b ON b.t = a.t + l.lag GROUP BY 1)
"""
P6 = StudyPeriod("2024-01-02", "2024-01-30", "2024-01-15")


def _periodicity(spark, sf):
    facts = dust_hourly(spark, sf).withColumnRenamed("hour", "timestamp")
    return studies.periodicity(facts, P6)


@query("p6_city_autocovariance", P6_CTE + "SELECT lag, round(acov, 6) AS acov FROM g", "dust_hourly")
def acov(spark, sf):
    return rounded(_periodicity(spark, sf)[0])


@query(
    "p6_city_periodogram",
    P6_CTE + """, m AS (SELECT lag AS t, acov - (SELECT avg(acov) FROM g) AS y, (SELECT count(*) FROM g) AS n FROM g),
f AS (SELECT unnest(generate_series(0, (SELECT count(*) // 2 FROM m))) AS k)
SELECT f.k, round(f.k / max(n)::DOUBLE, 9) AS freq,
round((pow(sum(y * cos(2 * pi() * ((f.k * t) % n) / n)), 2) + pow(sum(y * sin(2 * pi() * ((f.k * t) % n) / n)), 2)) / max(n)
* CASE WHEN f.k = 0 OR 2 * f.k = max(n) THEN 1 ELSE 2 END, 6) AS power FROM m CROSS JOIN f GROUP BY 1""",
    "dust_hourly",
)
def spectrum(spark, sf):
    out = _periodicity(spark, sf)[1]
    return rounded(rounded(out, 9, "freq"), 6, "power")
