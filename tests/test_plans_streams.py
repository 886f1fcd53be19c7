import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sensorgrid.config import Roles
from sensorgrid.model import trainer
from sensorgrid.operators import resample
from sensorgrid.plans import dataset, discovery, loading
from sensorgrid.schemas import SDS_COLUMNS, SDS_RAW
from sensorgrid.streaming import hourly, ingest, online
from test_select_join_fold import moved_after_filling

QUERIES = entry.queries()

T = dt.datetime


def test_hourly_dataset_columns_and_pairs(spark):
    dust = spark.createDataFrame(
        [(1, T(2018, 1, 1, h, m), float(h + m / 60), 1.0) for h in range(3) for m in (0, 30)],
        "sds_sensor bigint, timestamp timestamp, P1 double, P2 double",
    )
    meteo = spark.createDataFrame(
        [(b, T(2018, 1, 1, h, 5), 1.0 * b, 2.0, 3.0) for b in (10, 11) for h in (0, 2)],
        "bme_sensor bigint, timestamp timestamp, pressure double, temperature double, humidity double",
    )
    weather = spark.createDataFrame([(T(2018, 1, 1, h), float(h)) for h in range(2)], "hour timestamp, temp_meteo double")
    cols = ["lat", "lon", "sealevel_alt", "surface_alt", "nearest_park", "nearest_road", "nearest_indust"]
    dim = spark.createDataFrame(
        [(1, 10, *[1.0] * 7), (1, 11, *[2.0] * 7)], "sds_sensor bigint, bme_sensor bigint, " + ", ".join(f"{c} double" for c in cols)
    )
    got = dataset.hourly_dataset(dust, meteo, weather, dim).orderBy("bme_sensor", "timestamp").collect()
    assert len(got) == 6
    assert [r["P1"] for r in got[:3]] == [0.25, 1.25, 2.25]
    assert [r["pressure"] for r in got] == [10.0, None, 10.0, 11.0, None, 11.0]
    assert [r["temp_meteo"] for r in got[:3]] == [0.0, 1.0, None]
    assert {r["nearest_park"] for r in got[3:]} == {2.0}


def test_dataset_moves_no_filled_hours(spark, sf):
    plan = QUERIES["a2_pressure_altitude"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 1  # the hours of the station; filled hours of sensors have no pressure
    df = QUERIES["p2_hourly_dataset"](spark, sf)
    assert [line for line in moved_after_filling(df) if "BroadcastExchange" not in line] == []
    assert len(moved_after_filling(df)) == 1  # the hours of the station


def test_discovery_golden(spark):
    day = dt.date(2019, 12, 2)
    html = "".join(f'<a href="2019-12-02{s}">f</a>' for s in ("", "_csv1", "_csv2", "_csv3", "_csv4_indoor"))
    listings = spark.createDataFrame([(day, html), (dt.date(2019, 12, 3), '<a href="x">y</a>')], "day date, html string")
    none = spark.createDataFrame([], "name string")
    links = discovery.new_links(listings, none)
    assert {r["url"] for r in links.collect()} == {f"https://archive.sensor.community/2019-12-02/2019-12-02_csv{i}" for i in (1, 2, 3)}
    seen = spark.createDataFrame([("2019-12-02_csv1",)], "name string")
    assert discovery.new_links(listings, seen).count() == 2
    assert discovery.latest_new_links(links, F.lit("2019-12-04").cast("date")).count() == 3
    assert discovery.latest_new_links(links, F.lit("2019-12-20").cast("date")).count() == 0
    rows = spark.createDataFrame(
        [("2019-12-02_csv1", T(2019, 1, 10), "55.686", "37.589"), ("2019-12-02_csv2", T(2019, 1, 10), "10.686", "22.589"),
         ("2019-12-02_csv3", T(2019, 1, 10), "", "22.589")],
        "file string, timestamp timestamp, lat string, lon string",
    )
    found = discovery.discover(links, rows)
    assert {r["name"] for r in found.checked.collect()} == {"2019-12-02_csv1", "2019-12-02_csv2"}
    assert [r["sensor"] for r in found.accepted.collect()] == ["_csv1"]


def test_load_plan(spark):
    lines = spark.createDataFrame([("_sds011_sensor_1.csv",), ("_bme280_sensor_2.csv",), ("_sds011_sensor_3.csv",)], "value string")
    stored = spark.createDataFrame([(1, T(2019, 12, 3, 4)), (3, T(2019, 12, 9))], "sensor_id bigint, timestamp timestamp")
    plan = loading.load_plan(loading.listed_sensors(lines), stored, F.lit("2019-12-06").cast("date")).collect()
    days = lambda s: sorted(str(r["day"]) for r in plan if r["sensor_id"] == s)
    assert days(1) == ["2019-12-04", "2019-12-05"] and days(3) == []
    assert days(2)[0] == "2019-11-06" and len(days(2)) == 30
    typed = stored.withColumn("sensor_type", F.lit("bme280"))
    by_type = loading.load_plan(loading.listed_sensors(lines), typed, F.lit("2019-12-06").cast("date"))
    assert by_type.filter("sensor_id = 1").count() == 30  # the stored rows are of another type
    row = next(r for r in plan if r["sensor_id"] == 1)
    assert row["file"] == "1_sds011_sensor_.csv" and row["url"].endswith(f"{row['day']}_sds011_sensor_1.csv")


def test_load_plan_reaches_back_as_far_as_asked(spark):
    lines = spark.createDataFrame([("_sds011_sensor_1.csv",), ("_sds011_sensor_2.csv",)], "value string")
    stored = spark.createDataFrame([("1", "2019-10-01 05:00:00")], "sensor_id string, timestamp string").select(
        "sensor_id", F.col("timestamp").cast("timestamp"))
    sensors, today = loading.listed_sensors(lines), F.lit("2019-12-06").cast("date")
    stored = stored.withColumn("sensor_id", F.col("sensor_id").cast(sensors.schema["sensor_id"].dataType))

    def counts(**days):
        plan = loading.load_plan(sensors, stored, today, **days).groupBy("sensor_id").count().collect()
        return {int(r["sensor_id"]): r["count"] for r in plan}

    assert counts() == {1: 30, 2: 30} and counts(days=10) == {1: 10, 2: 10}
    assert counts(days=None) == {1: 65, 2: 30}


def test_station_load_interval(spark):
    rec = spark.createDataFrame([(T(2019, 12, 8, 21),), (T(2019, 12, 9, 21),)], "ts_local timestamp")
    today = lambda s: F.lit(s).cast("date")
    assert tuple(loading.station_load_interval(rec, today("2019-12-20")).first()) == (dt.date(2019, 12, 10), dt.date(2019, 12, 19))
    assert loading.station_load_interval(rec, today("2019-12-11")).count() == 0
    assert loading.station_load_interval(rec.limit(0), today("2019-12-11")).first()["start_day"] == dt.date(2019, 4, 1)


def _write_day(folder, name, rows):
    lines = [";".join(SDS_COLUMNS)] + [f"1;SDS011;1;55.7;37.6;{t};{v};;;1;;" for t, v in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_new_files_are_appended_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    run = lambda: ingest.append_available(
        ingest.reading_stream(spark, str(src), SDS_RAW), str(tmp_path / "t"), str(tmp_path / "c")
    ).awaitTermination()
    _write_day(src, "a_sds011_sensor_1.csv", [("2019-12-04T19:05:56", 15.77)])
    run()
    _write_day(src, "b_sds011_sensor_1.csv", [("2019-12-05T23:58:34", 5.63), ("bad", 1)])
    run()
    run()
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 3
    p = ingest.sensor_progress(table).first()
    assert (p["n"], p["first"], p["last"]) == (3, T(2019, 12, 4, 19, 5, 56), T(2019, 12, 5, 23, 58, 34))


@pytest.fixture
def parts(spark, tmp_path):
    """Readings of two sensors over four days, one file per day."""
    rows = [(s, T(2024, 1, 1 + h // 24, h % 24, m), 55.7 + s / 50, 37.5, float(1 + (h * 7 + m + s) % 13)) for s in (1, 2) for h in range(96) for m in (5, 40)]
    df = spark.createDataFrame(rows, "sds_sensor bigint, timestamp timestamp, lat double, lon double, P1 double")
    folder = str(tmp_path / "parts")
    for day in range(1, 5):
        df.filter(F.dayofmonth("timestamp") == day).coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def test_stream_hours_equal_batch(spark, parts, tmp_path):
    df, folder = parts
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = hourly.hourly_mean_stream(stream, ["sds_sensor"], ["P1"])
    ingest.append_available(out, str(tmp_path / "o"), str(tmp_path / "oc")).awaitTermination()
    last = df.agg(F.max("timestamp")).scalar()
    closed = lambda d: {tuple(r) for r in hourly.closed_hours(d, last).collect()}
    got = closed(spark.read.parquet(str(tmp_path / "o")).select("sds_sensor", "hour", "P1"))
    want = closed(resample.hourly_mean(df, ["sds_sensor"], ["P1"], "timestamp").select("sds_sensor", "hour", "P1"))
    assert got == want and len(got) > 180


def test_online_updates_replay_to_the_same_state(spark, parts, tmp_path):
    df, folder = parts
    roles = Roles()
    model = trainer.SparseModel(trainer.TargetScale.fit(df), roles=roles).build(df.filter("dayofmonth(timestamp) = 1"), 12)
    state = str(tmp_path / "state")
    with pytest.raises(ValueError):
        online.update_batch(state)(df, 0)
    online.write_state(model, spark, state, -1)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    online.update_available(stream, state, str(tmp_path / "sc"), roles).awaitTermination()
    rows = spark.read.parquet(state).orderBy("batch").collect()
    assert [r["batch"] for r in rows] == [-1, 0, 1] and [r["updates"] for r in rows] == [0, 1, 2]
    before = online.state_before(spark, state, 1).posterior
    online.update_batch(state, roles)(df.filter("dayofmonth(timestamp) > 2"), 1)  # replay of the last batch
    again = spark.read.parquet(state).filter("batch = 1").collect()
    assert len(again) == 1 and again[0]["m"] == 12 and before.z.shape == (12, 3)
