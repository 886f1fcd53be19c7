import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import joins
from sensorgrid.schemas import BME_COLUMNS, FEATURES, SDS_COLUMNS, SDS_RAW, STATION_COLUMNS
from sensorgrid.sources import elevation, features, forecast, listing, readings, station, tables

SDS = ";".join(SDS_COLUMNS)
BME = ";".join(BME_COLUMNS)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "19649_sds011_sensor_.csv").write_text(
        f"{SDS}\n19649;SDS011;9973;55.686;37.589;2019-01-10T19:05:56;15.77;;;7.95;;\n"
        "19649;SDS011;12232;55.728;37.476;2019-11-03T23:58:34;5.63;;;bad;;\n19649;SDS011;1;x;37.4;no time;1;;;2;;\n"
    )
    (tmp_path / "1_sds011_sensor_.csv").write_text("")
    (tmp_path / "2_sds011_sensor_.csv").write_text(SDS + "\n")
    (tmp_path / "20216_bme280_sensor_.csv").write_text(
        f"{BME}\n20228;BME280;10273;55.680;37.564;2019-04-04T00:01:28;98628.00;;;20.0;\n"
    )
    return str(tmp_path)


def test_reading_files(spark, folder):
    got = readings.read_dust(spark, f"{folder}/*sds011*.csv").orderBy(F.col("timestamp").asc_nulls_last()).collect()
    assert len(got) == 3  # the empty and the header-only file give no rows
    a, b, c = got
    assert (a["sensor_id"], a["sensor_type"], a["lat"], a["lon"], a["P1"], a["durP1"], a["P2"]) == (
        19649, "SDS011", 55.686, 37.589, 15.77, None, 7.95)
    assert a["timestamp"] == dt.datetime(2019, 1, 10, 19, 5, 56)
    assert b["P2"] is None and c["lat"] is None and c["timestamp"] is None
    assert (a["file_sensor_id"], a["file_sensor_type"]) == (19649, "SDS011")
    m = readings.read_meteo(spark, f"{folder}/*bme280*.csv").first()
    assert (m["sensor_id"], m["file_sensor_id"], m["pressure"], m["humidity"]) == (20228, 20216, 98628.0, None)
    raw = readings.read_raw(spark, f"{folder}/*sds011*.csv", SDS_RAW)
    assert readings.coerce(raw, numbers_only=True).filter("sensor_type IS NOT NULL").count() == 0


STATION_HEADER = ";".join(f'"{c}"' for c in ["Местное время"] + STATION_COLUMNS[1:])


def _station_row(when, t, po, wind="Ветер, дующий с запада", rrr="Осадков нет"):
    values = dict.fromkeys(STATION_COLUMNS, "")
    values.update(local_time=when, T=t, Po=po, U="83", DD=wind, Ff="1", W1=" ", VV="10.0", Td="0.0", RRR=rrr, tR="12",
                  Cl="Слоистых облаков", Nh=' нет. "90  или более, но не 100%')
    return ";".join(f'"{values[c]}"' for c in STATION_COLUMNS)


def test_station_file_with_preamble_quotes_and_gzip(spark, tmp_path):
    lines = ["# preamble"] * 6 + [STATION_HEADER] + [
        _station_row("04.04.2019 06:00", "3.0", "757.6"), _station_row("04.04.2019 03:00", "2.7", "757.6"),
    ]
    path = tmp_path / "w.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    records = station.read_station(spark, str(path))
    assert [r["T"] for r in station.oldest_first(records).collect()] == ["2.7", "3.0"]
    hourly = station.hourly_weather(spark, str(path)).orderBy("hour").collect()
    assert [r["hour"] for r in hourly] == [dt.datetime(2019, 4, 4, h) for h in range(4)]
    first, last = hourly[0], hourly[-1]
    assert len(hourly[0]) == 11  # the hour and ten weather columns
    assert first["temp_meteo"] == 2.7 and [r["temp_meteo"] for r in hourly[1:]] == [3.0] * 3
    assert first["pres_meteo"] == pytest.approx(757.6 * 133.322)
    assert (last["wind_direction"], last["prec_amount"], last["visibility"], last["dew_point_temp"]) == (
        "Ветер, дующий с запада", "Осадков нет", "10.0", 0.0)


def test_elevation_responses(spark):
    body = (
        '{"results":[{"dataset":"x","elevation":45,"location":{"lat":-43.5,"lng":172.5}},'
        '{"dataset":"x","elevation":402,"location":{"lat":27.6,"lng":1.98}},'
        '{"dataset":"x","elevation":46,"location":{"lat":-43.5,"lng":172.5}}],"status":"OK"}'
    )
    df = spark.createDataFrame([(1, body), (2, "not json")], "id int, body string")
    got = {(r["lat"], r["lon"]): r["elevation"] for r in elevation.parse_elevation(df, order="id").collect()}
    assert got == {(-43.5, 172.5): 46.0, (27.6, 1.98): 402.0}
    chunk = spark.createDataFrame([(0, [(1.5, 2.5), (3.0, 4.0)])], "chunk bigint, items array<struct<lat:double,lon:double>>")
    assert elevation.request_payload(chunk).first()["payload"] == "1.5,2.5|3.0,4.0"


def test_features_by_tag(spark):
    big = [(37.5, 55.7), (37.6, 55.7), (37.6, 55.8), (37.5, 55.8)]
    small = [(37.5, 55.7), (37.5001, 55.7), (37.5001, 55.7001)]
    rows = [
        (1, "way", {"leisure": "park"}, big), (2, "way", {"leisure": "park"}, small), (3, "relation", {"natural": "wood"}, big),
        (4, "node", {"leisure": "garden"}, big), (5, "way", {"highway": "primary"}, small), (6, "way", {"highway": "footway"}, small),
        (7, "way", {"landuse": "industrial"}, small), (8, "way", {}, small), (9, "way", None, small),
    ]
    parks, roads, indust = features.split_features(spark.createDataFrame(rows, FEATURES))
    ids = lambda df: sorted(r["feature_id"] for r in df.collect())
    assert (ids(parks), ids(roads), ids(indust)) == ([1, 3], [5], [7])


def test_listing_and_download_links(spark):
    html = '<a href="?C=N">Name</a><td>\n <a class="x" href=\'2019-12-02_csv1\'>f</a><link href="no"> <A HREF="2019-12-02_csv2">g</A>'
    got = listing.page_links(spark.createDataFrame([(1, html)], "page_id bigint, html string")).orderBy("pos")
    assert [r["href"] for r in got.collect()] == ["?C=N", "2019-12-02_csv1", "2019-12-02_csv2"]


def page(hours, drop=None, extra_cell=""):
    n = len(hours)
    cells = lambda vals: "".join(f"<td>{v}</td>" for v in vals)
    hints = [f"<div onmouseover=\"t(this, {i} mm,'')\"></div><div onmouseover=\"t(this, {i} in,'')\"></div>" for i in range(n)]
    rows = {
        "Местное время": hours, "Осадки, мм": hints, "Температура": [f"{i}.5 C" for i in range(n)],
        "Давление": [750 + i for i in range(n)], "Ветер": [f"\n{i} m" for i in range(n)],
        "направление": ["С-З x"] * n, "Влажность": [f"{60 + i}{extra_cell}" for i in range(n)],
    }
    body = "".join(f"<tr><td>{k}</td>{cells(v)}</tr>" for k, v in rows.items() if k != drop)
    return f"<html><table><tr><td>1</td></tr></table><table id='forecastTable_1_3'>{body}</table></html>"


def test_forecast_page(spark):
    hours = [(20 + i) % 24 for i in range(30)]
    pages = spark.createDataFrame(
        [(1, page(hours)), (2, page(hours, drop="Давление")), (3, "<html></html>"), (4, None), (5, page(["x"]))],
        "page_id bigint, html string",
    )
    seen = F.lit("2024-03-01 12:00:00").cast("timestamp")
    day = F.lit("2024-03-01").cast("date")
    assert forecast.tidy_forecast(pages, day, seen).count() == 30
    got = forecast.tidy_forecast(pages, day, seen, hours=24).orderBy("pos").collect()
    assert len(got) == 24 and {r["page_id"] for r in got} == {1}
    assert got[0]["Date-Time"] == dt.datetime(2024, 3, 1, 17) and got[4]["Date-Time"] == dt.datetime(2024, 3, 1, 21)
    assert got[23]["Date-Time"] == dt.datetime(2024, 3, 2, 16)
    r = got[3]
    assert (r["Weather"], r["Temp"], r["Pressure"], r["Wind_speed"], r["Wind_dir"], r["Humidity"]) == (" 3 mm", 3.5, 753.0, 3.0, "С-З", 63.0)
    assert {r["page_id"] for r in forecast.bad_pages(pages).collect()} == {2, 3, 4, 5}


def test_tables(spark, tmp_path):
    t = lambda d, h: dt.datetime(2021, 6, d, h)
    df = spark.createDataFrame([(1, t(1, 0), 1.0), (1, t(2, 5), 2.0), (2, t(3, 7), None)], "sds_sensor bigint, timestamp timestamp, P1 double")
    path = str(tmp_path / "d")
    tables.write_dataset(df, path)
    assert tables.read_dataset(spark, path).count() == 3
    part = tables.read_dataset(spark, path, "2021-06-02", "2021-06-03 07:00:00")
    assert [r["P1"] for r in part.collect()] == [2.0]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    tables.append_rows(df, str(tmp_path / "a"))
    tables.append_rows(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 6  # a repeated load stores rows again
    tables.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3
    tables.write_sensors(df, str(tmp_path / "s"))
    assert tables.read_sensors(spark, str(tmp_path / "s")).columns == df.columns


def test_loads_store_a_key_once(spark, tmp_path):
    """Repeated, overlapping and empty loads; copies inside a load; rows without a whole key."""
    at = lambda h: dt.datetime(2021, 6, 1, h)
    frame = lambda rows: spark.createDataFrame(rows, "sensor_id bigint, timestamp timestamp, v double, least string")
    path = str(tmp_path / "t")
    loads = [
        [(1, at(1), 5.0, "b"), (1, at(1), 5.0, "a"), (1, at(1), 7.0, None), (2, at(1), None, "x"), (2, at(1), 1.0, "x"), (3, None, 1.0, "n")],
        [(1, at(1), 0.0, "late"), (1, at(2), 2.0, "c"), (None, at(1), 9.0, "n"), (None, at(1), 9.0, "n")],
        [],
    ]
    want = [(1, at(1), 5.0, "a"), (2, at(1), None, "x"), (3, None, 1.0, "n"), (1, at(2), 2.0, "c"), (None, at(1), 9.0, "n"), (None, at(1), 9.0, "n")]
    for load in [*loads, loads[0][:5], loads[1][:2]]:
        tables.append_new_rows(frame(load), path)
    got = [tuple(r) for r in spark.read.parquet(path).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    only = spark.createDataFrame([(1, 1), (1, 1), (None, 2), (None, 2)], "a bigint, b bigint")
    assert sorted(map(tuple, joins.one_per_key(only, ["a", "b"]).collect()), key=str) == [(1, 1), (None, 2), (None, 2)]
    hot = frame([(1, at(1), float(k), "h") for k in range(500)])
    plan = joins.one_per_key(hot, ["sensor_id", "timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan
