"""Folds, samples, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorgrid.catalog.base import dust, events, labelled, meteo, query, readings, rounded, table
from sensorgrid.operators import aggregates, folds, joins, numbering, sampling, select
from sensorgrid.session import run_dir
from sensorgrid.sources import tables
from sensorgrid.sources.forecast import every_second, rollover_days

FOLDS = """
WITH b AS (SELECT min(timestamp) AS a, max(timestamp) AS z FROM labelled),
f AS (SELECT l.*, floor(date_diff('microsecond', a, timestamp) / 86400000000)::BIGINT AS fold,
date_diff('microsecond', a, z) AS span FROM labelled l, b),
k AS (SELECT * FROM f WHERE fold * 86400000000 < span)
"""


@query(
    "w2_anchored_time_folds",
    FOLDS + "SELECT sds_sensor, timestamp, fold FROM k",
    "labelled",
)
def time_folds(spark, sf):
    return folds.assign_folds(labelled(spark, sf)).select("sds_sensor", "timestamp", "fold")


@query(
    "w2_fold_steps",
    FOLDS.replace("86400000000", "21600000000")
    + "SELECT fold, row_number() OVER (ORDER BY fold) - 1 AS step FROM (SELECT DISTINCT fold FROM k)",
    "labelled",
)
def fold_steps(spark, sf):
    return folds.fold_steps(folds.assign_folds(labelled(spark, sf), step_hours=6))


@query(
    "a6_fold_errors",
    FOLDS + """SELECT fold, round(avg(pow(P1 - (P2 + 10), 2)), 5) AS mse, round(sqrt(avg(pow(P1 - (P2 + 10), 2))), 6) AS rmse
    FROM k GROUP BY 1""",
    "labelled",
)
def fold_errors(spark, sf):
    scored = folds.assign_folds(labelled(spark, sf)).withColumn("pred", F.col("P2") + 10)
    return rounded(rounded(aggregates.fold_errors(scored), 5, "mse"), 6, "rmse")


@query(
    "a7_error_summary",
    FOLDS + """SELECT round(avg(rmse), 6) AS mean_rmse, round(stddev_pop(rmse), 6) AS rmse_std FROM
    (SELECT fold, sqrt(avg(pow(P1 - (P2 + 10), 2))) AS rmse FROM k GROUP BY 1)""",
    "labelled",
)
def error_summary(spark, sf):
    scored = folds.assign_folds(labelled(spark, sf)).withColumn("pred", F.col("P2") + 10)
    return rounded(aggregates.error_summary(aggregates.fold_errors(scored)))


@query(
    "w3_prequential_mean",
    FOLDS
    + """, s AS (SELECT fold, sum(P1) AS s, count(P1) AS n FROM k GROUP BY 1),
p AS (SELECT fold, sum(s) OVER w / sum(n) OVER w AS pred FROM s
WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k.fold, round(max(p.pred), 6) AS pred, round(sqrt(avg(pow(k.P1 - p.pred, 2))), 6) AS rmse
FROM k JOIN p ON p.fold = k.fold WHERE p.pred IS NOT NULL GROUP BY 1""",
    "labelled",
)
def prequential(spark, sf):
    return rounded(folds.prequential_mean(folds.assign_folds(labelled(spark, sf))))


@query(
    "w1_first_two_rows_per_sensor",
    """SELECT sensor_id, ts, rn FROM (SELECT sensor_id, ts, row_number() OVER (PARTITION BY sensor_id ORDER BY ts, value) AS rn
    FROM readings) WHERE rn <= 2""",
    "readings",
)
def first_two(spark, sf):
    return aggregates.first_rows(readings(spark, sf), "sensor_id", ["ts", "value"], 2).select("sensor_id", "ts", "rn")


@query(
    "w4_midnight_rollover",
    """WITH c AS (SELECT event_id // 24 AS page_id, event_id % 24 AS pos, (event_id % 24 * 3 + event_id // 24) % 24 AS h FROM events)
    SELECT page_id, pos, h, coalesce(sum(CASE WHEN h = 23 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS days FROM c""",
)
def rollover(spark, sf):
    """Pages of 24 hour columns, three hours apart, from the event numbers."""
    page = F.floor(F.col("event_id") / 24).cast("bigint")
    cells = events(spark, sf).select(
        page.alias("page_id"), (F.col("event_id") % 24).alias("pos"), ((F.col("event_id") % 24 * 3 + page) % 24).alias("h")
    )
    order = Window.partitionBy("page_id").orderBy("pos")
    return cells.withColumn("days", rollover_days(F.col("h"), order))


@query(
    "w5_chunks_of_100_places",
    """WITH n AS (SELECT sensor_id, row_number() OVER (ORDER BY sensor_id) - 1 AS rn FROM (SELECT DISTINCT sensor_id FROM readings))
    SELECT rn // 100 AS chunk, count(*) AS n, string_agg(sensor_id::VARCHAR, '|' ORDER BY rn) AS payload FROM n GROUP BY 1""",
    "readings",
)
def chunks(spark, sf):
    ids = readings(spark, sf).select("sensor_id").distinct()
    parts = numbering.chunks(ids, 100, ["sensor_id"], numbering.quantile_bucket(ids, "sensor_id", 32), "sensor_id")
    return parts.select(
        "chunk", F.size("items").alias("n"), F.array_join(F.col("items").cast("array<string>"), "|").alias("payload")
    )


@query(
    "w6_every_second_value",
    """SELECT doc_id, pos // 2 AS pos, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents) WHERE pos % 2 = 0""",
)
def every_other(spark, sf):
    """Values 0, 2, 4, ... of a list; the words of a text play the list."""
    kept = every_second(F.split("text", " ", -1))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(kept).alias("pos", "word"))


@query(
    "l1_random_sensors",
    """WITH ids AS (SELECT sds_sensor FROM (SELECT DISTINCT sds_sensor FROM labelled)
    ORDER BY md5(sds_sensor::VARCHAR || '#42'), sds_sensor
    LIMIT (SELECT round_even(count(DISTINCT sds_sensor) * 0.25::DOUBLE, 0)::BIGINT FROM labelled))
    SELECT sds_sensor, timestamp, P1 FROM labelled WHERE sds_sensor IN (SELECT sds_sensor FROM ids)""",
    "labelled",
)
def random_sensors(spark, sf):
    df = labelled(spark, sf).select("sds_sensor", "timestamp", "P1")
    return sampling.random_sensors(df, aggregates.sample_size(df).scalar())


@query(
    "l2_random_rows",
    """SELECT DISTINCT sds_sensor, epoch_us(timestamp) AS us FROM labelled
    ORDER BY md5(sds_sensor::VARCHAR || '#' || us::VARCHAR || '#42'), sds_sensor, us LIMIT 200""",
    "labelled",
)
def random_rows(spark, sf):
    """200 rows drawn as inducing points."""
    df = labelled(spark, sf).select("sds_sensor", F.unix_micros("timestamp").alias("us")).distinct()
    return sampling.sampled_rows(df, 200, ["sds_sensor", "us"])


L3_PART = """(SELECT sds_sensor, us FROM (SELECT sds_sensor, epoch_us(timestamp) AS us, timestamp FROM labelled) WHERE timestamp {c} TIMESTAMP '2024-01-15'
ORDER BY md5(sds_sensor::VARCHAR || '#' || us::VARCHAR || '#42'), sds_sensor, us LIMIT {n})"""


@query(
    "l3_refreshed_rows",
    "SELECT * FROM " + L3_PART.format(c="<", n=140) + " UNION ALL SELECT * FROM " + L3_PART.format(c=">=", n=60),
    "labelled",
)
def refreshed_rows(spark, sf):
    """200 rows: 70 % from before the split, 30 % from after it."""
    df = labelled(spark, sf).withColumn("us", F.unix_micros("timestamp"))
    old, new = select.split_at(df, "2024-01-15")
    return sampling.refreshed_rows(old, new, 200, ["sds_sensor", "us"])


@query("l4_preview", "SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 5")
def preview(spark, sf):
    return select.preview(events(spark, sf).select("event_id", "ts", "value").orderBy("event_id"))


@query("l5_oldest_first", "SELECT event_id, ts, value FROM events ORDER BY ts")
def oldest_first(spark, sf):
    return events(spark, sf).select("event_id", "ts", "value").orderBy("ts")


@query(
    "u1_append_sources",
    """SELECT sds_sensor AS sensor_id, ts, P1, NULL::DOUBLE AS pressure FROM dust
    UNION ALL SELECT bme_sensor, ts, NULL::DOUBLE, pressure FROM meteo""",
    "dust meteo",
)
def append_sources(spark, sf):
    d = dust(spark, sf).select(F.col("sds_sensor").alias("sensor_id"), "ts", "P1")
    m = meteo(spark, sf).select(F.col("bme_sensor").alias("sensor_id"), "ts", "pressure")
    return joins.append_sources(d, m)


@query(
    "u3_new_names_minus_checked",
    """SELECT DISTINCT user_id || '.csv' AS name FROM events WHERE event_type = 'click' AND user_id NOT IN
    (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)""",
)
def new_names(spark, sf):
    """Names of one list that are not in another; rows of the first are kept as they are."""
    e = events(spark, sf)
    name = F.concat(F.col("user_id").cast("string"), F.lit(".csv"))
    listed = e.filter(F.col("event_type") == "click").select(name.alias("name")).distinct()
    checked = e.filter((F.col("event_type") == "signup") & (F.col("value") > 100)).select(name.alias("name"))
    return joins.not_of_sensors(listed, checked, "name")


@query(
    "w7_last_row_per_sensor",
    "SELECT sensor_id, max(ts) AS ts, arg_max(value, ts) AS value FROM readings GROUP BY 1",
    "readings",
)
def last_row(spark, sf):
    df = readings(spark, sf).withColumn("at", F.col("ts"))
    return aggregates.last_known(df, ["ts", "value"], "sensor_id", "at")


@query(
    "u2_repeated_load_keeps_copies",
    "SELECT sensor_id, count(*) AS n FROM (SELECT * FROM readings UNION ALL SELECT * FROM readings) GROUP BY 1",
    "readings",
)
def repeated(spark, sf):
    df = readings(spark, sf)
    return joins.append_sources(df, df).groupBy("sensor_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "u2_repeated_load_stores_keys_once",
    """SELECT sensor_id, ts, event_type, value FROM (
      SELECT *, row_number() OVER (PARTITION BY sensor_id, ts ORDER BY load, event_type NULLS FIRST, value NULLS FIRST) AS place FROM (
        SELECT 1 AS load, * FROM readings WHERE event_type IN ('click', 'view') UNION ALL SELECT 2 AS load, * FROM readings))
    WHERE place = 1 OR sensor_id IS NULL OR ts IS NULL""",
    "readings",
)
def repeated_once(spark, sf):
    """A load of some rows, then one of all rows: the table holds each sensor and time once, as first stored."""
    df, path = readings(spark, sf), run_dir(spark, "loads")
    for load in (df.filter(F.col("event_type").isin("click", "view")), df):
        tables.append_new_rows(load, path, keys=("sensor_id", "ts"), time="ts")
    return spark.read.schema(df.schema).parquet(path)
