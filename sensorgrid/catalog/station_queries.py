"""Percentiles over stations, outages, and what a run rejects."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import events, ground, place_lat, place_lon, place_sql, query, rounded
from sensorgrid.catalog.source_queries import forecast_pages
from sensorgrid.operators import joins, stations
from sensorgrid.operators.counts import RunCounts, unreadable_readings
from sensorgrid.operators.resample import hourly_mean
from sensorgrid.schemas import SDS_COLUMNS
from sensorgrid.session import run_dir, stored
from sensorgrid.sources import forecast, readings

HIGH = 20.0
#: Where the sensors of the smaller tables are.
CENTRE = (55.3, 36.9)
#: A station gives 0 in some of its hours.
ZERO = "(user_id * 31 + {hours}) % 5 = 0"
STATIONS_SQL = f"""
WITH r AS (SELECT user_id AS station, ts, CASE WHEN {ZERO.format(hours="epoch_us(ts) // 3600000000")} THEN 0.0 ELSE value END AS pm FROM events),
h AS (SELECT station, date_trunc('hour', ts) AS hour, avg(pm) AS pm FROM r GROUP BY 1, 2),
b AS (SELECT *, last_value(CASE WHEN pm <> 0 THEN pm END IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
first_value(CASE WHEN pm <> 0 THEN pm END IGNORE NULLS) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
count(CASE WHEN pm <> 0 THEN 1 END) OVER (PARTITION BY station ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM h),
f AS (SELECT *, coalesce(pm = 0 AND before >= {HIGH} AND after >= {HIGH}, false) AS outage FROM b)
"""


def station_hours(spark, sf):
    """Hourly means of the readings of all users as stations, with zeros in some hours."""
    zero = F.expr(ZERO.format(hours="unix_micros(cast(ts AS timestamp)) div 3600000000L"))
    rows = events(spark, sf).select(
        F.col("user_id").alias("station"), F.col("ts").cast("timestamp").alias("ts"), F.when(zero, 0.0).otherwise(F.col("value")).alias("pm"))
    return hourly_mean(rows, ["station"], ["pm"], fill=False)


@query(
    "x1_station_percentiles",
    STATIONS_SQL + f""", p AS (SELECT DISTINCT user_id AS station, {place_sql("user_id // 2")} FROM events),
near AS (SELECT station FROM p WHERE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians({CENTRE[0]}) - radians(lat)) / 2), 2)
+ cos(radians(lat)) * cos(radians({CENTRE[0]})) * pow(sin((radians({CENTRE[1]}) - radians(lon)) / 2), 2)))) <= 20000.0)
SELECT hour, count(CASE WHEN outage THEN 1 END) AS outages, count(CASE WHEN NOT outage THEN 1 END) AS count,
""" + ", ".join(f"round(quantile_cont(CASE WHEN NOT outage THEN pm END, {p / 100}), 6) AS p{p}" for p in stations.PERCENTS)
    + " FROM f JOIN near USING (station) GROUP BY 1 HAVING count(CASE WHEN NOT outage THEN 1 END) > 0",
)
def station_percentiles(spark, sf):
    """Percentiles over the stations within 20 km of a place; hours of outages do not count."""
    place = F.floor(F.col("user_id") / 2).cast("bigint")
    places = events(spark, sf).select(F.col("user_id").alias("station"), place_lat(place).alias("lat"), place_lon(place).alias("lon")).distinct()
    return rounded(stations.station_percentiles(station_hours(spark, sf), places, "station", "pm", HIGH, centre=CENTRE))


@query(
    "x1_zero_runs",
    STATIONS_SQL + """SELECT station, min(hour) AS start, max(hour) AS "end", count(*) AS hours, round(any_value(before), 6) AS before,
round(any_value(after), 6) AS after, bool_or(outage) AS outage FROM f WHERE pm = 0 GROUP BY station, island""",
)
def zero_runs(spark, sf):
    return rounded(stations.zero_runs(station_hours(spark, sf), "station", "pm", HIGH))


def _raw(spark, sf):
    """Readings as text; some have no place, no time or no sensor."""
    place = F.floor(F.col("user_id") / 2).cast("bigint")
    made = {
        "sensor_id": F.when(F.col("event_id") % 17 == 0, "?").otherwise(F.col("user_id").cast("string")), "sensor_type": F.lit("SDS011"),
        "lat": F.when(F.col("event_id") % 13 == 0, "north").otherwise(place_lat(place).cast("string")), "lon": place_lon(place).cast("string"),
        "timestamp": F.when(F.col("event_id") % 11 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), "P1": F.col("value").cast("string"),
    }
    return events(spark, sf).select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in SDS_COLUMNS])


@query(
    "j6_f17_rejected_rows",
    f"""WITH e AS (SELECT event_id, user_id, {place_sql("user_id // 2")} FROM events),
g AS (SELECT DISTINCT lat, lon FROM e WHERE user_id % 5 > 0),
k AS (SELECT e.*, g.lat IS NOT NULL AS known FROM e LEFT JOIN g USING (lat, lon))
SELECT 'load' AS run, unnest(['readings', 'readings', 'readings', 'readings', 'placed', 'placed']) AS step,
unnest(['rows', 'no_position', 'no_time', 'no_sensor', 'rows', 'no_elevation']) AS counter,
unnest([count(*), count(CASE WHEN event_id % 13 = 0 THEN 1 END), count(CASE WHEN event_id % 11 = 0 THEN 1 END), count(CASE WHEN event_id % 17 = 0 THEN 1 END),
count(CASE WHEN event_id % 13 > 0 THEN 1 END), count(CASE WHEN event_id % 13 > 0 AND NOT known THEN 1 END)]) AS n FROM k""",
)
def rejected_rows(spark, sf):
    """Readings go to a table with their ground elevation; what could not be used is counted on the way."""
    seen = RunCounts("load")
    read = seen.watch(readings.coerce(_raw(spark, sf)), "readings", **unreadable_readings())
    place = F.floor(F.col("user_id") / 2).cast("bigint")
    k = F.from_json("props", "k double")["k"]
    heights = events(spark, sf).filter(F.col("user_id") % 5 > 0).groupBy(place_lat(place).alias("lat"), place_lon(place).alias("lon")).agg(F.max(k).alias("elevation"))
    placed = joins.attach_elevation(read.filter("lat IS NOT NULL AND lon IS NOT NULL").withColumn("sealevel_alt", F.lit(125.0)), heights)
    stored(seen.watch(placed, "placed", no_elevation=F.col("surface_alt").isNull()), "loaded")
    return seen.table(spark)


@query(
    "st7_s10_page_counts",
    """WITH p AS (SELECT count(DISTINCT ts::DATE) AS good, count(DISTINCT CASE WHEN extract('day' FROM ts) % 5 = 0 THEN ts::DATE END) AS bad FROM events)
SELECT 'pages' AS run, unnest(['pages', 'good_pages']) AS step, 'rows' AS counter, unnest([good, good - bad]) AS n FROM p""",
)
def page_counts(spark, sf):
    """Every fifth day's page is cut short; pages and good pages are counted while the rows are written."""
    seen = RunCounts("pages")
    html = F.when(F.dayofmonth("day") % 5 == 0, F.left("html", F.length("html") / 2)).otherwise(F.col("html"))
    pages = forecast_pages(spark, sf).withColumn("html", html)
    forecast.tidy_forecast(pages, F.col("day"), F.to_timestamp("day"), counts=seen).write.parquet(run_dir(spark, "forecast"))
    return seen.table(spark)
