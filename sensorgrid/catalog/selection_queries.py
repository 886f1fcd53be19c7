"""Filters, projections, role views."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import dust, events, labelled, meteo, positions, query, rounded
from sensorgrid.catalog.join_queries import LINK_NAMES, archive_links
from sensorgrid.config import DISCOVERY_BOX, MAP_BOX, Roles, StudyPeriod
from sensorgrid.operators import aggregates, select

RAW = Roles(time="ts", lat="lat", lon="lon", sensor="user_id", target="value")


@query(
    "f1_station_columns_in_pascal",
    """SELECT ts AS ts_utc, value AS temp_meteo, (740.0 + value / 10) * 133.322::DOUBLE AS pres_meteo, event_type AS wind_direction
    FROM events""",
)
def station_columns(spark, sf):
    """Rename station columns; pressure from mmHg to pascal."""
    from sensorgrid.functions.scalar import mmhg_to_pa

    return events(spark, sf).select(
        F.col("ts").alias("ts_utc"),
        F.col("value").alias("temp_meteo"),
        mmhg_to_pa(F.lit(740.0) + F.col("value") / 10).alias("pres_meteo"),
        F.col("event_type").alias("wind_direction"),
    )


@query("f2_project_meteo", "SELECT bme_sensor, ts, pressure, temperature, humidity FROM meteo", "meteo")
def project_meteo(spark, sf):
    return meteo(spark, sf)


@query("f2_project_dust", "SELECT sds_sensor, ts, P1, P2 FROM dust", "dust")
def project_dust(spark, sf):
    return dust(spark, sf)


@query("f3_dust_sensors", "SELECT * FROM positions WHERE sensor_type = 'SDS011'", "positions")
def dust_sensors(spark, sf):
    return select.dust_sensors(positions(spark, sf))


@query("f3_meteo_sensors", "SELECT * FROM positions WHERE sensor_type = 'BME280'", "positions")
def meteo_sensors(spark, sf):
    return select.meteo_sensors(positions(spark, sf))


SHIFTED = "(SELECT sensor_id, sensor_type, lat - 0.05::DOUBLE + (sensor_id % 7) / 5.0::DOUBLE AS lat, " \
    "lon + (sensor_id % 5) / 4.0::DOUBLE AS lon FROM positions)"


def _shifted(spark, sf):
    return positions(spark, sf).withColumns(
        {
            "lat": F.col("lat") - F.lit(0.05) + (F.col("sensor_id") % 7) / F.lit(5.0),
            "lon": F.col("lon") + (F.col("sensor_id") % 5) / F.lit(4.0),
        }
    )


@query(
    "f4_inside_discovery_box",
    f"SELECT * FROM {SHIFTED} WHERE lat BETWEEN 55.26::DOUBLE AND 56.47::DOUBLE AND lon BETWEEN 36.82::DOUBLE AND 38.40::DOUBLE",
    "positions",
)
def discovery_box(spark, sf):
    return select.inside(_shifted(spark, sf), DISCOVERY_BOX)


@query(
    "f5_inside_map_box",
    f"SELECT * FROM {SHIFTED} WHERE lat BETWEEN 55.48::DOUBLE AND 59.03::DOUBLE AND lon BETWEEN 37.1::DOUBLE AND 38.05::DOUBLE",
    "positions",
)
def map_box(spark, sf):
    return select.inside(_shifted(spark, sf), MAP_BOX)


@query(
    "f6_time_slice",
    "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:00:00'",
)
def time_slice(spark, sf):
    df = events(spark, sf).select("event_id", "ts")
    return select.tloc(df, slice("2024-01-05", "2024-01-09 12:00:00"), RAW)


@query("f6_time_from", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-25'")
def time_from(spark, sf):
    return select.tloc(events(spark, sf).select("event_id", "ts"), slice("2024-01-25", None), RAW)


@query(
    "f6_time_point",
    "SELECT sds_sensor, hour, round(P1, 6) AS P1 FROM dust_hourly WHERE hour = TIMESTAMP '2024-01-10 07:00:00'",
    "dust_hourly",
)
def time_point(spark, sf):
    from sensorgrid.catalog.base import dust_hourly

    df = dust_hourly(spark, sf).select("sds_sensor", "hour", "P1")
    return rounded(select.tloc(df, "2024-01-10 07:00:00", Roles(time="hour")))


@query(
    "f7_place_slice",
    "SELECT sds_sensor, timestamp, lat, lon FROM labelled WHERE lat >= 55.3::DOUBLE AND lat < 55.5::DOUBLE AND lon >= 36.9::DOUBLE",
    "labelled",
)
def place_slice(spark, sf):
    df = labelled(spark, sf).select("sds_sensor", "timestamp", "lat", "lon")
    return select.sploc(df, slice(55.3, 55.5), slice(36.9, None))


@query(
    "f7_place_point",
    "SELECT sds_sensor, timestamp, lat, lon FROM labelled WHERE lat = 55.26::DOUBLE AND lon = 36.82::DOUBLE",
    "labelled",
)
def place_point(spark, sf):
    return select.sploc(labelled(spark, sf).select("sds_sensor", "timestamp", "lat", "lon"), 55.26, 36.82)


PERIOD = StudyPeriod("2024-01-08", "2024-01-22", "2024-01-15")


@query(
    "f8_study_period",
    "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'",
)
def period(spark, sf):
    return select.study_period(events(spark, sf).select("event_id", "ts", "value"), PERIOD, "ts")


@query(
    "f9_train_and_validation",
    """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'train' ELSE 'validation' END AS part FROM events
    WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""",
)
def split(spark, sf):
    df = select.study_period(events(spark, sf).select("event_id", "ts"), PERIOD, "ts")
    train, val = select.split_at(df, PERIOD.split, "ts")
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("validation"))).drop("ts")


@query(
    "f10_rows_with_target",
    "SELECT sds_sensor, hour, round(P1, 6) AS P1 FROM dust_hourly WHERE P1 IS NOT NULL",
    "dust_hourly",
)
def with_target(spark, sf):
    from sensorgrid.catalog.base import dust_hourly

    return rounded(select.with_target(dust_hourly(spark, sf).select("sds_sensor", "hour", "P1")))


@query(
    "f11_floor_target",
    "SELECT event_id, CASE WHEN value <= 1 THEN 1.0::DOUBLE ELSE value END AS value FROM events",
)
def floor_target(spark, sf):
    return select.floor_target(events(spark, sf).select("event_id", "value"), "value")


@query("f12_feature_columns", "SELECT P2, timestamp, lat, lon, sds_sensor FROM labelled", "labelled")
def features(spark, sf):
    return select.select_x(labelled(spark, sf), Roles(extra=("P2",)))


@query(
    "f12_replaced_target",
    "SELECT timestamp, lat, lon, sds_sensor, round(ln(CASE WHEN P1 > 0 THEN P1 END), 6) AS P1 FROM (SELECT * EXCLUDE (P2) FROM labelled)",
    "labelled",
)
def target(spark, sf):
    df = labelled(spark, sf).drop("P2")
    return rounded(select.replace_y(df, F.ln("P1")), 6, "P1")


@query(
    "f14_day_links",
    f"WITH {LINK_NAMES} SELECT day, href FROM links WHERE contains(href, '2024-01-03') AND NOT contains(href, 'indoor') "
    "AND length(substr(href, 11)) > 0",
    "readings",
)
def day_links(spark, sf):
    return select.day_links(archive_links(spark, sf), "2024-01-03")


@query(
    "f16_rows_at_latest_time",
    "SELECT event_id, user_id, ts, value FROM events WHERE ts = (SELECT max(ts) FROM events)",
)
def latest(spark, sf):
    return aggregates.at_latest(events(spark, sf).select("event_id", "user_id", "ts", "value"), "ts")


@query(
    "f17_rows_with_position",
    """SELECT event_id, TRY_CAST(lat AS DOUBLE) AS lat, TRY_CAST(lon AS DOUBLE) AS lon FROM (SELECT event_id,
    CASE WHEN user_id % 3 = 0 THEN 'n/a' ELSE value::DECIMAL(10, 2)::VARCHAR END AS lat,
    CASE WHEN user_id % 5 = 0 THEN '' ELSE user_id::VARCHAR END AS lon FROM events)
    WHERE TRY_CAST(lat AS DOUBLE) IS NOT NULL AND TRY_CAST(lon AS DOUBLE) IS NOT NULL""",
)
def positioned(spark, sf):
    """Positions arrive as text; a third of the latitudes and a fifth of the longitudes is no number."""
    raw = events(spark, sf).select(
        "event_id",
        F.when(F.col("user_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("decimal(10,2)").cast("string")).alias("lat"),
        F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string")).alias("lon"),
    )
    return select.with_position(raw)
