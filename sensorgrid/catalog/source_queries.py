"""Readers applied to text made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import events, query, rounded, table
from sensorgrid.functions import text
from sensorgrid.schemas import SDS_COLUMNS, SDS_RAW
from sensorgrid.session import run_dir
from sensorgrid.sources import elevation, forecast, listing, readings, station, tables
from sensorgrid.streaming import ingest

S1_SQL = """
SELECT sensor_id, sensor_type, lat, lon, ts AS timestamp, P1, P2 FROM (
SELECT user_id AS sensor_id, 'SDS011' AS sensor_type, 55.5::DOUBLE AS lat, 37.5::DOUBLE AS lon,
CASE WHEN user_id % 9 = 0 THEN NULL ELSE date_trunc('second', ts) END AS ts, value AS P1, CASE WHEN user_id % 4 > 0 THEN value END AS P2 FROM events)
"""


def _raw_dust(spark, sf):
    """Readings as the text columns of a sensor file, some of them broken."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    amount = F.col("value").cast("decimal(10,2)").cast("string")
    made = {
        "sensor_id": F.col("user_id").cast("string"), "sensor_type": F.lit("SDS011"), "location": F.lit("1"),
        "lat": F.lit("55.5"), "lon": F.lit("37.5"),
        "timestamp": F.when(F.col("user_id") % 9 == 0, "not a time").otherwise(iso),
        "P1": amount, "P2": F.when(F.col("user_id") % 4 > 0, amount).otherwise("error"),
    }
    empty = F.lit(None).cast("string")
    return events(spark, sf).select(*[made.get(c, empty).alias(c) for c in SDS_COLUMNS])


@query("s1_coerced_readings", S1_SQL)
def coerced(spark, sf):
    df = readings.coerce(_raw_dust(spark, sf))
    return df.select("sensor_id", "sensor_type", "lat", "lon", "timestamp", "P1", "P2")


@query("s1_reading_files", S1_SQL)
def files(spark, sf):
    """Write the readings as ``;`` files, then read them with the file source."""
    path = run_dir(spark, "reading-files")
    _raw_dust(spark, sf).write.option("sep", ";").option("header", "true").csv(path)
    df = readings.read_dust(spark, path)
    return df.select("sensor_id", "sensor_type", "lat", "lon", "timestamp", "P1", "P2")


@query(
    "s2_raw_columns_as_text",
    "SELECT CASE WHEN user_id % 9 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp, user_id::VARCHAR AS sensor_id, "
    "CASE WHEN user_id % 4 > 0 THEN NULL ELSE 'error' END AS broken FROM events",
)
def raw_columns(spark, sf):
    """The columns of a file as they stand, before any coercion."""
    path = run_dir(spark, "raw-files")
    _raw_dust(spark, sf).write.option("sep", ";").option("header", "true").csv(path)
    raw = readings.read_raw(spark, path, SDS_RAW)
    return raw.select("timestamp", "sensor_id", F.when(F.col("P2") == "error", F.col("P2")).alias("broken"))


@query(
    "s2_altitude_columns_uncoerced",
    "SELECT user_id AS sensor_id, date_trunc('second', ts) AS timestamp, 98000.0 + value * 10 AS pressure FROM events WHERE event_type IN ('purchase', 'error')",
)
def altitude_read(spark, sf):
    from sensorgrid.schemas import BME_COLUMNS

    made = {
        "sensor_id": F.col("user_id").cast("string"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "pressure": (F.lit(98000.0) + F.col("value") * 10).cast("string"),
    }
    empty = F.lit(None).cast("string")
    raw = events(spark, sf).filter(F.col("event_type").isin("purchase", "error")).select(
        *[made.get(c, empty).alias(c) for c in BME_COLUMNS]
    )
    return readings.coerce(raw).select("sensor_id", "timestamp", "pressure")


@query(
    "s3_sensor_from_file_name",
    "SELECT event_id, user_id AS stored_id, upper(event_type) AS stored_type, user_id AS archive_id, event_type AS archive_type FROM events",
)
def file_sensor(spark, sf):
    stored = text.stored_file_sensor(F.concat_ws("_", F.col("user_id").cast("string"), "event_type", F.lit("sensor_.csv")))
    archive = text.archive_file_sensor(text.last_path_part(text.archive_url("user_id", F.to_date("ts"), "event_type")))
    return events(spark, sf).select(
        "event_id", stored["sensor_id"].alias("stored_id"), stored["sensor_type"].alias("stored_type"),
        archive["sensor_id"].alias("archive_id"), archive["sensor_type"].alias("archive_type"),
    )


S4_SQL = """
SELECT date_trunc('minute', ts) - INTERVAL 3 HOUR AS ts_utc, value AS temp_meteo, round((740 + user_id) * 133.322::DOUBLE, 6) AS pres_meteo,
'Ветер, дующий с запада' AS wind_direction, 'Осадков нет' AS prec_amount FROM events WHERE event_type = 'signup'
"""


def _raw_station(spark, sf):
    from sensorgrid.schemas import STATION_COLUMNS

    made = {
        "local_time": F.date_format("ts", "dd.MM.yyyy HH:mm"),
        "T": F.col("value").cast("decimal(10,2)").cast("string"),
        "Po": (F.col("user_id") + 740).cast("string"),
        "DD": F.lit("Ветер, дующий с запада"),
        "RRR": F.lit("Осадков нет"),
    }
    return events(spark, sf).filter(F.col("event_type") == "signup").select(
        *[made.get(c, F.lit("")).alias(c) for c in STATION_COLUMNS]
    )


def _station_columns(df):
    return df.select(
        "ts_utc", "temp_meteo", F.round("pres_meteo", 6).alias("pres_meteo"), "wind_direction", "prec_amount"
    )


@query("s4_station_records", S4_SQL)
def station_records(spark, sf):
    return _station_columns(station.select_weather(station.with_utc(_raw_station(spark, sf))))


@query("s5_gzip_station_file", S4_SQL)
def station_file(spark, sf):
    """Write quoted gzip files and read them back with the station source."""
    path = run_dir(spark, "station-files")
    _raw_station(spark, sf).write.option("sep", ";").option("quoteAll", "true").option("compression", "gzip").csv(path)
    return _station_columns(station.select_weather(station.read_station(spark, path)))


@query(
    "s6_sensor_table_round_trip",
    "SELECT * FROM pairs",
    "pairs",
)
def sensor_table(spark, sf):
    from sensorgrid.catalog.base import pairs

    path = run_dir(spark, "sensors")
    tables.write_sensors(pairs(spark, sf), path)
    return tables.read_sensors(spark, path)


@query(
    "s7_dataset_round_trip",
    "SELECT sds_sensor, hour AS timestamp, round(P1, 6) AS P1 FROM dust_hourly WHERE hour >= TIMESTAMP '2024-01-08' "
    "AND hour < TIMESTAMP '2024-01-22 06:00:00'",
    "dust_hourly",
)
def dataset(spark, sf):
    """Day folders; the read prunes by day."""
    from sensorgrid.catalog.base import dust_hourly

    path = run_dir(spark, "dataset")
    tables.write_dataset(dust_hourly(spark, sf).select("sds_sensor", F.col("hour").alias("timestamp"), "P1"), path)
    return rounded(tables.read_dataset(spark, path, "2024-01-08", "2024-01-22 06:00:00"))


@query(
    "s8_metric_sink",
    """WITH f AS (SELECT timestamp::DATE AS day, sqrt(avg(pow(P1 - 20, 2))) AS rmse FROM labelled GROUP BY 1)
    SELECT round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS rmse_std, count(*) AS steps FROM f""",
    "labelled",
)
def metrics(spark, sf):
    from sensorgrid.catalog.base import labelled
    from sensorgrid.operators.aggregates import fold_errors

    path = run_dir(spark, "metrics")
    scored = labelled(spark, sf).withColumn("pred", F.lit(20.0)).withColumn("day", F.to_date("timestamp"))
    tables.write_metrics(fold_errors(scored, "day"), f"{path}/result", f"{path}/plot", "day")
    steps = spark.read.schema("step date, RMSE double").json(f"{path}/plot").count()
    back = spark.read.schema("`mean RMSE` double, `RMSE std` double").json(f"{path}/result")
    return rounded(back.select(
        F.col("mean RMSE").alias("mean_rmse"), F.col("RMSE std").alias("rmse_std"), F.lit(steps).cast("bigint").alias("steps")
    ))


@query(
    "s9_page_links",
    r"""SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages""",
)
def page_links(spark, sf):
    return listing.page_links(table(spark, sf, "pages")).drop("pos")


S13_SQL = """
WITH e AS (SELECT user_id, event_id, (props->>'k')::DOUBLE AS k FROM events)
SELECT lat, lon, arg_max(elevation, seq) AS elevation FROM
(SELECT user_id::DOUBLE AS lat, 1.0::DOUBLE AS lon, event_id * 2 AS seq, k AS elevation FROM e
UNION ALL SELECT user_id::DOUBLE, 2.0::DOUBLE, event_id * 2 + 1, k + 1 FROM e) GROUP BY 1, 2
"""


@query("s13_elevation_responses", S13_SQL)
def elevations(spark, sf):
    """One response of two places per reading; the last one of a place wins."""
    k = F.from_json("props", "k double")["k"]

    def item(lon, up):
        place = F.struct(F.col("user_id").cast("double").alias("lat"), F.lit(lon).alias("lng"))
        return F.struct((k + up).alias("elevation"), place.alias("location"))

    body = F.to_json(F.struct(F.array(item(1.0, 0), item(2.0, 1)).alias("results"), F.lit("OK").alias("status")))
    return elevation.parse_elevation(events(spark, sf).select("event_id", body.alias("body")), order="event_id")


# --- forecast pages: one per day, the hours of the day as columns -------------------------
PAGE_SQL = """
WITH h AS (SELECT ts::DATE AS day, extract('hour' FROM ts)::INT AS h, count(*) AS n, max(value) AS top, min(user_id) AS low
FROM events GROUP BY 1, 2),
p AS (SELECT *, (date_diff('day', DATE '1970-01-01', day))::BIGINT AS page_id,
row_number() OVER (PARTITION BY day ORDER BY (h + 24 - extract('day' FROM day)::INT % 24) % 24) - 1 AS pos FROM h),
r AS (SELECT *, coalesce(sum(CASE WHEN h = 23 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS roll FROM p)
"""


def forecast_pages(spark, sf):
    """``page_id, day, html`` in the layout of the forecast site, from hourly figures of the readings."""
    per_hour = events(spark, sf).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.min("user_id").alias("low")
    )
    start = F.dayofmonth("day") % 24
    columns = per_hour.groupBy("day").agg(
        F.sort_array(F.collect_list(F.struct(((F.col("h") + 24 - start) % 24).alias("o"), "h", "n", "top", "low"))).alias("c")
    )

    def line(label, cell):
        tds = F.array_join(F.transform("c", lambda e: F.concat(F.lit("<td>"), cell(e), F.lit("</td>"))), "")
        return F.concat(F.lit(f"<tr><td><b>{label}</b></td>"), tds, F.lit("</tr>"))

    def text_of(c):
        return c.cast("string")

    def hint(e):
        mark = F.concat(F.lit("<div onmouseover=\"tooltip(this, "), text_of(e["n"]), F.lit(" {u}, 'x')\">*</div>"))
        return F.concat(F.replace(mark, F.lit("{u}"), F.lit("mm")), F.replace(mark, F.lit("{u}"), F.lit("in")))

    top = lambda e: e["top"].cast("decimal(10,2)").cast("string")
    html = F.concat(
        F.lit("<html><table id='other'><tr><td>x</td></tr></table><table id='forecastTable_1_3'>"),
        line("Местное время", lambda e: text_of(e["h"])),
        line("Осадки, мм", hint),
        line("Температура, °C", lambda e: F.concat(top(e), F.lit(" <i>50 F</i>"))),
        line("Давление, мм рт. ст.", lambda e: F.concat(text_of(e["low"] + 740), F.lit(" 29.1"))),
        line("Ветер: скорость, м/с", lambda e: F.concat(F.lit("\n "), text_of(e["n"]))),
        line("направление", lambda e: F.concat(F.lit("С-"), text_of(e["low"] % 8), F.lit(" x"))),
        line("Влажность, %", lambda e: text_of(e["low"])),
        F.lit("</table></html>"),
    )
    return columns.select(F.unix_date("day").cast("bigint").alias("page_id"), "day", html.alias("html"))


@query(
    "s10_forecast_pages",
    PAGE_SQL
    + """SELECT page_id, pos, day::TIMESTAMP AS snapshot, day::TIMESTAMP + to_days(roll) + to_hours(h) - INTERVAL 3 HOUR AS time_utc,
' ' || n || ' mm' AS weather, top AS temp, (low + 740)::DOUBLE AS pressure, n::DOUBLE AS wind_speed, 'С-' || (low % 8) AS wind_dir,
low::DOUBLE AS humidity FROM r""",
)
def pages_to_rows(spark, sf):
    rows = forecast.tidy_forecast(forecast_pages(spark, sf), F.col("day"), F.to_timestamp("day"))
    return rows.withColumnsRenamed({
        "Parsing date": "snapshot", "Date-Time": "time_utc", "Weather": "weather", "Temp": "temp", "Pressure": "pressure",
        "Wind_speed": "wind_speed", "Wind_dir": "wind_dir", "Humidity": "humidity",
    })


@query(
    "st7_forecast_page_stream",
    PAGE_SQL + "SELECT pos, top AS temp, low::DOUBLE AS humidity, n::DOUBLE AS wind_speed FROM r",
)
def page_stream(spark, sf):
    """Page files arrive, one of them broken; their snapshot time is the file time and left out here."""
    root = run_dir(spark, "forecast")
    pages = forecast_pages(spark, sf)
    broken = pages.agg(F.max("page_id").alias("page_id")).select(F.col("page_id") + 1, F.lit("<html>gone</html>").alias("html"))
    arrived = pages.select("page_id", "html").union(broken)
    arrived.repartition("page_id").write.partitionBy("page_id").text(f"{root}/pages")
    ingest.forecast_available(spark, f"{root}/pages", f"{root}/rows", f"{root}/checkpoint", recursiveFileLookup="true").awaitTermination()
    rows = spark.read.parquet(f"{root}/rows")
    return rows.select("pos", F.col("Temp").alias("temp"), F.col("Humidity").alias("humidity"), F.col("Wind_speed").alias("wind_speed"))


@query("s11_append_new_days", S1_SQL)
def append_days(spark, sf):
    """Two rounds of arriving daily files; the second takes only the new ones."""
    root = run_dir(spark, "daily")
    raw = _raw_dust(spark, sf)
    early = F.col("timestamp") < "2024-01-16"
    for part in (raw.filter(early), raw.filter(~early)):
        part.write.mode("append").option("sep", ";").option("header", "true").csv(f"{root}/files")
        stream = ingest.reading_stream(spark, f"{root}/files", SDS_RAW)
        ingest.append_available(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    table = spark.read.schema(stream.schema).parquet(f"{root}/table")
    return table.select("sensor_id", "sensor_type", "lat", "lon", "timestamp", "P1", "P2")
