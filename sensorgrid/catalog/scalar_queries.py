"""Scalar functions over the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import events, labelled, meteo, query, readings, rounded, table
from sensorgrid.functions import kernels, scalar, text

C1_SQL = """
SELECT event_id, CASE WHEN t = '' OR t = 'n/a' OR t = '1.5f' THEN NULL ELSE TRY_CAST(t AS DOUBLE) END AS number FROM (SELECT event_id,
CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a' WHEN 2 THEN '1.5f' WHEN 3 THEN ' ' || value::DECIMAL(10, 2)::VARCHAR
ELSE value::DECIMAL(10, 2)::VARCHAR END AS t FROM events)
"""


@query("c1_number_coercion", C1_SQL)
def numbers(spark, sf):
    """Readings as text, some of them no numbers."""
    plain = F.col("value").cast("decimal(10,2)").cast("string")
    kind = F.col("user_id") % 5
    raw = F.when(kind == 0, "").when(kind == 1, "n/a").when(kind == 2, "1.5f").when(kind == 3, F.concat(F.lit(" "), plain))
    return events(spark, sf).select("event_id", scalar.to_number(raw.otherwise(plain)).alias("number"))


C2_SQL = """
SELECT event_id, TRY_CAST(t AS TIMESTAMP) AS ts FROM (SELECT event_id,
CASE WHEN user_id % 6 = 0 THEN 'broken' ELSE strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') END AS t FROM events)
"""


@query("c2_time_coercion", C2_SQL)
def times(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("user_id") % 6 == 0, "broken").otherwise(iso)
    return events(spark, sf).select("event_id", scalar.to_time(raw).alias("ts"))


@query(
    "c3_station_time_and_day",
    """SELECT event_id, strptime(strftime(ts, '%d.%m.%Y %H:%M'), '%d.%m.%Y %H:%M') AS local_time, ts::DATE AS day FROM events""",
)
def station_times(spark, sf):
    raw = F.date_format("ts", "dd.MM.yyyy HH:mm")
    return events(spark, sf).select(
        "event_id", scalar.station_time(raw).alias("local_time"), scalar.station_day(raw).alias("day")
    )


@query(
    "c4_station_time_to_utc",
    "SELECT event_id, ts - INTERVAL 3 HOUR AS ts_utc FROM events",
)
def utc(spark, sf):
    """Moscow time is three hours ahead throughout the data."""
    return events(spark, sf).select("event_id", scalar.to_utc(F.col("ts").cast("timestamp"), "Europe/Moscow").alias("ts_utc"))


@query(
    "c5_hours_since_start",
    "SELECT event_id, round(date_diff('microsecond', (SELECT min(ts) FROM events), ts) / 3.6e9, 6) AS hours FROM events",
)
def hours(spark, sf):
    df = events(spark, sf)
    start = df.agg(F.min("ts")).scalar()
    return rounded(df.select("event_id", scalar.hours_since("ts", start).alias("hours")))


@query(
    "c6_days_to_load",
    """SELECT sensor_id, unnest(generate_series(d, DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day FROM
    (SELECT sensor_id, max(ts)::DATE + 1 AS d FROM readings GROUP BY 1)""",
    "readings",
)
def days(spark, sf):
    last = readings(spark, sf).groupBy("sensor_id").agg(F.date_add(F.to_date(F.max("ts")), 1).alias("d"))
    return last.select("sensor_id", F.explode(scalar.days_between("d", F.lit("2024-02-05").cast("date"))).alias("day"))


@query(
    "c7_load_start",
    """SELECT sensor_id, greatest(max(ts)::DATE + 1, DATE '2024-01-29')::DATE AS start_day FROM readings GROUP BY 1""",
    "readings",
)
def load_start(spark, sf):
    from sensorgrid.operators.aggregates import high_water, load_start

    marks = high_water(readings(spark, sf), "sensor_id", "ts")
    return load_start(marks, F.lit("2024-01-29").cast("date")).drop("next_day")


@query(
    "c8_archive_url",
    """SELECT event_id, 'https://archive.sensor.community/' || strftime(ts, '%Y-%m-%d') || '/' || strftime(ts, '%Y-%m-%d') || '_' || event_type
    || '_sensor_' || user_id || '.csv' AS url, user_id || '_' || event_type || '_sensor_.csv' AS stored FROM events""",
)
def urls(spark, sf):
    return events(spark, sf).select(
        "event_id",
        text.archive_url("user_id", F.to_date("ts"), "event_type").alias("url"),
        F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.lit("sensor"), F.lit(".csv")).alias("stored"),
    )


@query(
    "c9_url_parts",
    """SELECT page_id, string_split(url, '/')[-1] AS name, substr(string_split(url, '/')[-1], 11) AS suffix,
    contains(url, 'www') AS has_www FROM pages""",
)
def url_parts(spark, sf):
    name = text.last_path_part("url")
    return table(spark, sf, "pages").select(
        "page_id", name.alias("name"), text.after_date(name).alias("suffix"), F.contains("url", F.lit("www")).alias("has_www")
    )


@query(
    "c10_link_without_parent_parts",
    r"""SELECT page_id, array_to_string(list_filter(string_split(regexp_extract('go <a href=' || url || '/../x> end', '(https?://[^\s<>"''#]+)', 1), '/'),
    lambda p: p <> '..'), '/') AS link FROM pages""",
)
def download_link(spark, sf):
    from sensorgrid.sources.listing import download_links

    responses = table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("go <a href="), "url", F.lit("/../x> end")).alias("body")
    )
    return download_links(responses).drop("body")


@query(
    "c11_first_token",
    r"""SELECT conv_id, turn, CASE WHEN t <> '' THEN t END AS word, CASE WHEN t <> '' THEN TRY_CAST(t AS DOUBLE) END AS number FROM
    (SELECT conv_id, turn, regexp_extract(trim(text), '^(\S*)', 1) AS t FROM (SELECT conv_id, turn, turn || ' ' || text AS text FROM conversations))""",
)
def tokens(spark, sf):
    line = F.concat(F.col("turn").cast("string"), F.lit(" "), "text")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.first_token(line).alias("word"), text.first_number(line).alias("number")
    )


C12_LABEL = {"click": "Температура, °C", "view": "Ветер: скорость, направление", "purchase": "Давление, мм",
             "error": "Влажность, %", "signup": "прочее"}


@query(
    "c12_row_role",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'temp' WHEN 'view' THEN 'wind_dir' WHEN 'purchase' THEN 'pressure'
    WHEN 'error' THEN 'humidity' END AS role FROM events""",
)
def roles(spark, sf):
    """Labels by event type; the one with two marks takes the later role."""
    label = F.create_map(*[F.lit(v) for kv in C12_LABEL.items() for v in kv])[F.col("event_type")]
    return events(spark, sf).select("event_id", text.row_role(label).alias("role"))


@query(
    "c13_units_and_altitude_step",
    """SELECT bme_sensor, ts, round((740.0 + temperature) * 133.322::DOUBLE, 6) AS pa,
    round(-(8000.0 / (pressure / 1000.0) * (1.0 + 0.00366 * temperature)) * ((pressure - 99000.0) / 1000.0), 6) AS step FROM meteo""",
    "meteo",
)
def units(spark, sf):
    return rounded(meteo(spark, sf).select(
        "bme_sensor", "ts", scalar.mmhg_to_pa(F.lit(740.0) + F.col("temperature")).alias("pa"),
        scalar.altitude_step("pressure", "temperature", F.lit(99000.0)).alias("step"),
    ))


@query(
    "c14_surface_altitude",
    "SELECT event_id, round((125.0 + value) - (props->>'k')::DOUBLE, 6) AS surface_alt FROM events",
)
def surface(spark, sf):
    """Sea-level altitude minus ground elevation."""
    ground = F.from_json("props", "k double")["k"]
    return rounded(events(spark, sf).select("event_id", scalar.surface_altitude(F.lit(125.0) + F.col("value"), ground).alias("surface_alt")))


@query(
    "c15_standardised_log_target",
    """WITH m AS (SELECT avg(ln(CASE WHEN P1 > 0 THEN P1 END)) AS mean, stddev_pop(ln(CASE WHEN P1 > 0 THEN P1 END)) AS sd FROM labelled)
    SELECT sds_sensor, timestamp, round((ln(CASE WHEN P1 > 0 THEN P1 END) - mean) / sd, 6) AS z, round(exp((ln(CASE WHEN P1 > 0 THEN P1 END) - mean) / sd * sd + mean), 6) AS back
    FROM labelled, m""",
    "labelled",
)
def standardised(spark, sf):
    from sensorgrid.operators.aggregates import fit_target

    df = labelled(spark, sf)
    fit = fit_target(df).select(F.struct("mean", "sd").alias("f")).scalar()
    z = scalar.standardise_log("P1", fit["mean"], fit["sd"])
    return rounded(df.select(
        "sds_sensor", "timestamp", z.alias("z"), scalar.unstandardise_log(z, fit["mean"], fit["sd"]).alias("back")
    ))


@query(
    "c16_half_even_and_roots",
    "SELECT event_id, round_even(value * 0.25::DOUBLE, 0)::BIGINT AS quarter, round(sqrt(pow(value - 50, 2)), 6) AS gap FROM events",
)
def roots(spark, sf):
    return rounded(events(spark, sf).select(
        "event_id", scalar.half_even(F.col("value") * 0.25).cast("bigint").alias("quarter"),
        F.sqrt(F.pow(F.col("value") - 50, 2)).alias("gap"),
    ))


# --- kernels as column expressions: every reading against a fixed centre -----------------
def _against_centre(spark, sf):
    df = labelled(spark, sf)
    start = df.agg(F.min("timestamp")).scalar()
    here = [scalar.hours_since("timestamp", start), F.col("lon"), F.col("lat")]
    return df, here, [F.lit(360.0), F.lit(37.6), F.lit(55.75)]


_X = ("SELECT sds_sensor, timestamp, date_diff('microsecond', (SELECT min(timestamp) FROM labelled), timestamp) / 3.6e9 - 360.0 AS dt, "
      "sqrt(pow(lon - 37.6::DOUBLE, 2) + pow(lat - 55.75::DOUBLE, 2)) AS ds FROM labelled")
MATERN_SQL = "(1 + sqrt(3.0::DOUBLE) * abs({d}) / {l}::DOUBLE) * exp(-sqrt(3.0::DOUBLE) * abs({d}) / {l}::DOUBLE)"
PERIODIC_SQL = "exp(-0.5 * pow(sin(pi() * {d} / {p}) / 12.0, 2))"
TIME_SQL = "({t} + {t} * ({c}))".format(t=MATERN_SQL.format(d="dt", l="5.0"), c=" + ".join(PERIODIC_SQL.format(d="dt", p=p) for p in (8, 10, 30, 2)))


@query(
    "m1_matern32_kernel",
    f"SELECT sds_sensor, timestamp, round({MATERN_SQL.format(d='ds', l='0.05')}, 6) AS k FROM ({_X})",
    "labelled",
)
def matern(spark, sf):
    df, a, b = _against_centre(spark, sf)
    return rounded(df.select("sds_sensor", "timestamp", kernels.space_cov().column(a, b).alias("k")))


@query(
    "m2_periodic_kernel",
    f"SELECT sds_sensor, timestamp, round({PERIODIC_SQL.format(d='dt', p=8)}, 6) AS k FROM ({_X})",
    "labelled",
)
def periodic(spark, sf):
    df, a, b = _against_centre(spark, sf)
    return rounded(df.select("sds_sensor", "timestamp", kernels.Periodic((0,), 8.0, 12.0).column(a, b).alias("k")))


@query(
    "m3_combined_kernels",
    f"SELECT sds_sensor, timestamp, round({TIME_SQL}, 6) AS time_cov, round({TIME_SQL} * {MATERN_SQL.format(d='ds', l='0.05')}, 6) AS basic FROM ({_X})",
    "labelled",
)
def combined(spark, sf):
    df, a, b = _against_centre(spark, sf)
    return rounded(df.select(
        "sds_sensor", "timestamp", kernels.get_kernel("time_cov").column(a, b).alias("time_cov"),
        kernels.get_kernel("basic").column(a, b).alias("basic"),
    ))
