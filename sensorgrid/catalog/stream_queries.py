"""Streams over the readings, run until all that has arrived is done."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import METEO_ID_BASE, events, pairs, query, rounded, weather_hourly
from sensorgrid.catalog.model_queries import M, PERIOD, study
from sensorgrid.catalog.source_queries import S1_SQL, _raw_dust
from sensorgrid.model import trainer
from sensorgrid.operators import select
from sensorgrid.schemas import SDS_RAW
from sensorgrid.session import local_state_width, run_dir, stored
from sensorgrid.streaming import hourly, ingest, online, progress as sensor_state, upsert


def event_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    # The glob takes the table as one file or as a folder of files.
    return (
        spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
        .select(F.col("user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("timestamp"), "event_type", "value")
    )


def dust_stream(spark, sf):
    return event_stream(spark, sf).filter(F.col("event_type").isin("click", "view")).select(
        F.col("sensor_id").alias("sds_sensor"), "timestamp", F.col("value").alias("P1"), (F.col("value") / 3).alias("P2")
    )


def meteo_stream(spark, sf):
    return event_stream(spark, sf).filter(F.col("event_type").isin("purchase", "error")).select(
        (F.col("sensor_id") + METEO_ID_BASE).alias("bme_sensor"), "timestamp",
        (F.lit(98000.0) + F.col("value") * 10).alias("pressure"),
    )


def finish(spark, stream, name):
    """Append the stream to a new table in the shared folder and read the table."""
    root = run_dir(spark, name)
    with local_state_width(spark):
        ingest.append_available(stream, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


@query("st1_arriving_files", S1_SQL)
def arriving(spark, sf):
    root = run_dir(spark, "arriving")
    _raw_dust(spark, sf).write.option("sep", ";").option("header", "true").csv(root)
    table = finish(spark, ingest.reading_stream(spark, root, SDS_RAW), "ingested")
    return table.select("sensor_id", "sensor_type", "lat", "lon", "timestamp", "P1", "P2")


CLOSED = "hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM {t}) - INTERVAL {h} HOUR"
HOURLY = "SELECT sds_sensor, date_trunc('hour', ts) AS hour, avg(P1) AS P1, avg(P2) AS P2 FROM dust GROUP BY 1, 2"


@query(
    "st2_hourly_mean",
    f"SELECT sds_sensor, hour, round(P1, 6) AS P1, round(P2, 6) AS P2 FROM ({HOURLY}) WHERE " + CLOSED.format(t="dust", h=2),
    "dust",
)
def hourly_mean(spark, sf):
    """Final hours only; the others are still open when the stream stops."""
    stream = hourly.hourly_mean_stream(dust_stream(spark, sf), ["sds_sensor"], ["P1", "P2"])
    last = events(spark, sf).filter(F.col("event_type").isin("click", "view")).agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return rounded(hourly.closed_hours(finish(spark, stream, "hourly"), last))


@query("st3_redelivered_rows", "SELECT DISTINCT sensor_id, ts AS timestamp, value FROM readings", "readings")
def redelivered(spark, sf):
    """Every reading arrives twice."""
    twice = event_stream(spark, sf).withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2))))
    once = ingest.drop_redelivered(twice.select("sensor_id", "timestamp", "value"), ["sensor_id", "timestamp"])
    return finish(spark, once, "deduplicated")


@query(
    "st4_stream_with_station_weather",
    "SELECT sds_sensor, d.ts AS timestamp, P1, round(temp_meteo, 6) AS temp_meteo, wind_direction FROM dust d "
    "LEFT JOIN weather_hourly w ON w.hour = date_trunc('hour', d.ts)",
    "dust weather_hourly",
)
def enriched(spark, sf):
    stream = dust_stream(spark, sf).select("sds_sensor", "timestamp", "P1", F.date_trunc("hour", "timestamp").alias("hour"))
    # A table, so that a micro-batch reads it and does not work it out again.
    static = stored(weather_hourly(spark, sf).select("hour", "temp_meteo", "wind_direction"), "weather")
    return rounded(finish(spark, hourly.enrich(stream, static, ["hour"]), "enriched").drop("hour"), 6, "temp_meteo")


@query(
    "st5_paired_streams",
    f"""WITH h AS ({HOURLY}), m AS (SELECT bme_sensor, date_trunc('hour', ts) AS hour, avg(pressure) AS pressure FROM meteo GROUP BY 1, 2)
    SELECT h.sds_sensor, p.bme_sensor, h.hour, round(h.P1, 6) AS P1, round(m.pressure, 6) AS pressure FROM h JOIN pairs p ON p.sds_sensor = h.sds_sensor
    LEFT JOIN m ON m.bme_sensor = p.bme_sensor AND m.hour = h.hour
    WHERE h.hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR""",
    "dust meteo pairs",
)
def paired(spark, sf):
    """Hours that are final on both streams."""
    joined = hourly.pair_streams(
        dust_stream(spark, sf), meteo_stream(spark, sf), pairs(spark, sf), ["P1"], ["pressure"]
    )
    last = events(spark, sf).agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    return rounded(hourly.closed_hours(finish(spark, joined, "paired"), last, delay="2 hours"))


@query("st6_online_model")
def online_model(spark, sf):
    """Four spans of days, each one micro-batch, update the model; one state row per batch.

    A span is written and then read to its end before the next one arrives, so a batch always
    holds the same rows.
    """
    df = study(spark, sf)
    first, rest = select.split_at(df, PERIOD.split)
    root = run_dir(spark, "online")
    model = trainer.SparseModel(trainer.TargetScale.fit(first)).build(first, M)
    online.write_state(model, spark, f"{root}/state", -1)
    day = F.to_date("timestamp")
    span = rest.agg(F.min(day).alias("first"), (F.datediff(F.max(day), F.min(day)) + 1).alias("days")).first()
    part = F.floor(F.datediff(day, F.lit(span["first"])) * 4 / F.lit(span["days"]))
    with local_state_width(spark):
        for k in range(4):
            rest.filter(part == k).write.mode("append").parquet(f"{root}/days")
            stream = spark.readStream.schema(df.schema).parquet(f"{root}/days")
            online.update_available(stream, f"{root}/state", f"{root}/checkpoint").awaitTermination()
    return rounded(spark.read.parquet(f"{root}/state").select("batch", "noise", "bound", "m", "updates"))


@query(
    "st8_sensor_progress",
    "SELECT sds_sensor, count(*) AS n, min(ts) AS first, max(ts) AS last FROM dust GROUP BY 1",
    "dust",
)
def progress(spark, sf):
    table = finish(spark, dust_stream(spark, sf), "progress")
    return ingest.sensor_progress(table, "sds_sensor")


SPANS = 3
#: Spans of equal length over the time of all events; the number of a row's span.
SPAN_SQL = f"(epoch_us({{t}}) - (SELECT min(epoch_us(ts)) FROM events)) * {SPANS} // ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events) + {{wide}})"


def arriving_spans(spark, sf, arrival, wide_us=1):
    """The events with the number of the span in which they arrive."""
    ends = events(spark, sf).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b")).first()
    span = F.floor((F.unix_micros(arrival) - F.lit(ends["a"])) * SPANS / F.lit(ends["b"] - ends["a"] + wide_us))
    return events(spark, sf).withColumn("span", span)


def in_spans(rows, root, start, spans=SPANS):
    """Write one span of ``rows`` after the other to ``root`` and run ``start`` to its end after each."""
    for k in range(spans):
        rows.filter(F.col("span") == k).drop("span").write.mode("append").parquet(f"{root}/arrived")
        start(rows.sparkSession.readStream.schema(rows.drop("span").schema).parquet(f"{root}/arrived")).awaitTermination()


SILENCE_HOURS = 48


@query(
    "st8_progress_and_silent_sensors",
    f"""WITH g AS (SELECT sds_sensor, ts, lead(ts) OVER (PARTITION BY sds_sensor ORDER BY ts) AS after FROM dust)
    SELECT sds_sensor, 'progress' AS kind, count(*) AS n, min(ts) AS first, max(ts) AS last, NULL::TIMESTAMP AS until FROM dust GROUP BY 1
    UNION ALL SELECT sds_sensor, 'silent', 0, ts, ts, after FROM g
    WHERE after > ts + INTERVAL {SILENCE_HOURS} HOUR
    OR after IS NULL AND ts + INTERVAL {SILENCE_HOURS} HOUR <= (SELECT max(ts) FROM dust) - INTERVAL 2 HOUR""",
    "dust",
)
def silent_sensors(spark, sf):
    """Three spans of days arrive one after the other; state per sensor, and timers that report two days without a reading."""
    root = run_dir(spark, "silent")
    time = F.col("ts").cast("timestamp")
    rows = arriving_spans(spark, sf, time).filter(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("sds_sensor"), time.alias("timestamp"), "span")

    def start(stream):
        told = sensor_state.progress_stream(stream, "sds_sensor", silence_hours=SILENCE_HOURS)
        return ingest.append_available(told, f"{root}/table", f"{root}/checkpoint")

    with sensor_state.timer_state(spark):
        in_spans(rows, root, start)
    told = spark.read.parquet(f"{root}/table")
    none = F.lit(None)
    latest = sensor_state.latest_progress(told, "sds_sensor").select(
        "sds_sensor", F.lit("progress").alias("kind"), "n", "first", "last", none.cast("timestamp").alias("until"))
    return latest.unionByName(sensor_state.silences(told, "sds_sensor").select(
        "sds_sensor", F.lit("silent").alias("kind"), F.lit(0).cast("bigint").alias("n"), F.col("last").alias("first"), "last", "until"))


#: Minutes after its time at which a reading arrives, up to two hours.
LATE_US = "(event_id * 37 % 120) * 60000000"


@query(
    "st2_late_corrections",
    f"""WITH d AS (SELECT user_id AS sds_sensor, date_trunc('hour', ts) AS hour, value AS P1,
    {SPAN_SQL.format(t="ts + to_microseconds(" + LATE_US + ")", wide=7_200_000_000)} AS span FROM events WHERE event_type IN ('click', 'view'))
    SELECT sds_sensor, hour, round(avg(P1), 6) AS P1, count(DISTINCT span) AS versions FROM d GROUP BY 1, 2""",
)
def late_corrections(spark, sf):
    """Readings arrive up to two hours late, in three spans: hours already written are written again, the newest version counts."""
    root = run_dir(spark, "corrections")
    time = F.col("ts").cast("timestamp")
    late = F.timestamp_micros(F.unix_micros(time) + F.expr(LATE_US.replace("60000000", "60000000L")))
    rows = arriving_spans(spark, sf, late, 7_200_000_000).filter(F.col("event_type").isin("click", "view")).select(
        F.col("user_id").alias("sds_sensor"), time.alias("timestamp"), F.col("value").alias("P1"), "span")
    hours = None

    def start(stream):
        nonlocal hours
        hours = hourly.hourly_mean_stream(stream, ["sds_sensor"], ["P1"])
        return upsert.upsert_available(hours, f"{root}/table", f"{root}/checkpoint")

    with local_state_width(spark):
        in_spans(rows, root, start)
    table = upsert.versions(spark, f"{root}/table", hours.schema)
    written = table.groupBy("sds_sensor", "hour").agg(F.count(F.lit(1)).alias("versions"))
    newest = upsert.current_hours(table, ["sds_sensor"]).drop("batch")
    return rounded(newest.join(written, ["sds_sensor", "hour"]), 6, "P1")
