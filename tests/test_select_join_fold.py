import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from sensorgrid.accessor import spat
from sensorgrid.config import DISCOVERY_BOX, Roles
from sensorgrid.operators import aggregates, folds, joins, resample, sampling, select


@pytest.fixture(scope="module")
def ds(spark):
    rows = [
        (dt.datetime(2021, 3, 1 + i), 3.0 + i, 6.0 + i, 9 + i, 12 + i, 15 + i, [10.0, 15.0, 20.0][i], 100 + i) for i in range(3)
    ]
    return spark.createDataFrame(
        rows, "timestamp timestamp, lat double, lon double, sds_sensor bigint, x int, y int, P1 double, other int"
    )


def test_roles(ds):
    assert set(select.select_x(ds, Roles(extra=("x",))).columns) == {"timestamp", "lat", "lon", "sds_sensor", "x"}
    assert select.select_y(ds, Roles(target="y")).columns == ["y"]
    assert select.replace_x(ds, lon=F.lit(1.0)).first()["lon"] == 1.0
    assert select.replace_y(ds, F.lit(0), Roles(target="y")).first()["y"] == 0
    assert ds.first()["lon"] == 6.0
    with pytest.raises(AttributeError):
        select.check_roles(ds.drop("lat"))
    with pytest.raises(AttributeError):
        select.replace_x(ds, other=F.lit(1))


def test_half_open_selection(ds):
    assert select.tloc(ds, "2021-03-01").count() == 1
    assert select.tloc(ds, slice("2021-03-01", "2021-03-03")).count() == 2
    assert select.tloc(ds, slice(None, "2021-03-02")).count() == 1
    assert select.tloc(ds, slice("2021-03-01", None)).count() == 3
    assert select.tloc(ds, slice(None, None)).count() == 3
    assert select.sploc(ds, 3, 6).count() == 1
    assert select.sploc(ds, slice(3, 5)).count() == 2


def test_accessor(ds):
    view = spat(ds)
    assert set(view.with_x_columns(["x"]).x.columns) == {"timestamp", "lat", "lon", "sds_sensor", "x"}
    assert view.with_y_column("y").y.columns == ["y"]
    assert view.replace_x(lon=F.lit(1.0)).x.first()["lon"] == 1.0 and view.replace_y(F.lit(0)).y.first()["P1"] == 0
    assert view.tloc["2021-03-01":"2021-03-03"].count() == 2 and view.tloc["2021-03-01"].count() == 1
    assert view.sploc[3, 6].count() == 1 and view.sploc[3:5, :].count() == 2
    assert view.random_sensors(2).count() == 2 and view.locations().count() == 3 and view.series("P1").count() == 3
    with pytest.raises(AttributeError):
        spat(ds.drop("lat"))


def test_selection_is_pushed_to_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    plan = select.tloc(df, slice("2024-01-05", "2024-01-09"), Roles(time="ts"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
    assert "event_type" not in plan
    latest = aggregates.at_latest(df, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ts,ScalarSubquery" in latest


def test_random_sensors(ds):
    assert sampling.random_sensors(ds, 2).count() == 2
    assert sampling.random_sensors(ds, 4).count() == 3
    a = {r[0] for r in sampling.sampled_ids(ds, 2).collect()}
    assert a == {r[0] for r in sampling.sampled_ids(ds.repartition(7), 2).collect()}
    kept = {r["sds_sensor"] for r in joins.not_of_sensors(ds, sampling.sampled_ids(ds, 2)).collect()}
    assert len(kept) == 1 and not kept & a


def test_sample_of_many_ids_has_exact_size(spark):
    ids = spark.range(20000).withColumnRenamed("id", "sds_sensor")
    assert sampling.sampled_ids(ids, 4999).count() == 4999


def test_colocated_pairs(spark):
    pos = spark.createDataFrame(
        [(1, "SDS011", 1.0, 2.0), (2, "BME280", 1.0, 2.0), (3, "SDS011", 3.0, 5.0), (4, "BME280", 4.0, 6.0),
         (5, "SDS011", float("nan"), 1.0), (6, "BME280", float("nan"), 1.0), (7, "SDS011", None, 1.0), (8, "BME280", None, 1.0)],
        "sensor_id bigint, sensor_type string, lat double, lon double",
    )
    assert [tuple(r) for r in joins.pair_colocated(pos).collect()] == [(1, 2, 1.0, 2.0)]


def test_pressure_altitude_golden(spark):
    hour = dt.datetime(2019, 4, 4)
    meteo = spark.createDataFrame([(11111, hour, 98628.0, 20.0)], "bme_sensor bigint, hour timestamp, pressure double, temperature double")
    station = spark.createDataFrame([(hour, 757.6 * 133.322)], "hour timestamp, pres_meteo double")
    assert joins.pressure_altitude(meteo, station).first()["sealevel_alt"] == pytest.approx(331.90, abs=0.01)


def test_surface_altitude_golden(spark):
    s = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 2.0, 6.0), (3.0, 3.0, 7.0), (9.0, 9.0, 7.0)], "lat double, lon double, sealevel_alt double")
    e = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, 2.0, 1.0), (3.0, 3.0, 2.0)], "lat double, lon double, elevation double")
    assert [r["surface_alt"] for r in joins.attach_elevation(s, e).orderBy("lat").collect()] == [5.0, 5.0, 5.0, None]
    assert [tuple(r) for r in joins.missing_elevation(s, e).collect()] == [(9.0, 9.0)]


def test_unseen_links_golden(spark):
    links = spark.createDataFrame([(f"2019-12-02{s}",) for s in ("", "_csv1", "_csv2", "_csv3", "_csv4_indoor")] + [("measurements.txt",)], "href string")
    day = select.day_links(links, "2019-12-02")
    checked = spark.createDataFrame([("2019-12-01_csv1",)], "name string")
    assert {r["href"] for r in day.collect()} == {"2019-12-02_csv1", "2019-12-02_csv2", "2019-12-02_csv3"}
    assert {r["href"] for r in joins.unseen_links(day, checked).collect()} == {"2019-12-02_csv2", "2019-12-02_csv3"}


def test_box_edges(spark):
    b = DISCOVERY_BOX
    mid_lat, mid_lon = (b.min_lat + b.max_lat) / 2, (b.min_lon + b.max_lon) / 2
    pts = [(mid_lat, mid_lon), (b.min_lat, b.max_lon), (b.min_lat - 1, mid_lon), (b.max_lat + 1, mid_lon), (mid_lat, b.min_lon - 1), (mid_lat, b.max_lon + 1)]
    assert select.inside(spark.createDataFrame(pts, "lat double, lon double"), b).count() == 2


def test_time_folds(spark):
    t0 = dt.datetime(2021, 1, 1, 5)
    hours = [0, 1, 23, 24, 30, 72, 96]
    df = spark.createDataFrame([(t0 + dt.timedelta(hours=h), float(h)) for h in hours], "timestamp timestamp, P1 double")
    got = [(r["P1"], r["fold"]) for r in folds.assign_folds(df).orderBy("P1").collect()]
    assert got == [(0.0, 0), (1.0, 0), (23.0, 0), (24.0, 1), (30.0, 1), (72.0, 3)]  # the row on the last boundary has no fold
    assert folds.assign_folds(df, include_last=True).count() == 7
    assert [(r["fold"], r["step"]) for r in folds.fold_steps(folds.assign_folds(df)).orderBy("fold").collect()] == [(0, 0), (1, 1), (3, 2)]
    assert folds.assign_folds(df.limit(1)).count() == 0


def test_dimension_by_pair_and_by_first_pair(spark):
    facts = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.6)], "sds_sensor bigint, bme_sensor bigint, P1 double")
    dim = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0)], "sds_sensor bigint, bme_sensor bigint, lat double")
    by_pair = joins.attach_dimension(facts, dim, columns=["lat"])
    assert [r["lat"] for r in by_pair.orderBy("bme_sensor").collect()] == [1.0, 2.0]
    first = joins.attach_dimension(facts, dim, ["sds_sensor"], ["lat"])
    assert [r["lat"] for r in first.orderBy("bme_sensor").collect()] == [1.0, 1.0]


def test_last_known_skips_nulls(spark):
    df = spark.createDataFrame(
        [(1, dt.datetime(2021, 1, 1), 5.0, 1.0), (1, dt.datetime(2021, 1, 2), None, 2.0)], "sds_sensor bigint, timestamp timestamp, a double, b double"
    )
    assert tuple(aggregates.last_known(df, ["a", "b"]).first()) == (1, 5.0, 2.0)


def test_second_row_per_file(spark):
    t = dt.datetime
    df = spark.createDataFrame(
        [("f", t(2021, 1, 1), 1.0), ("f", t(2021, 1, 2), 2.0), ("f", t(2021, 1, 3), 3.0), ("g", t(2021, 1, 1), 9.0)],
        "file string, timestamp timestamp, lat double",
    )
    assert {tuple(r) for r in aggregates.sample_position(df, columns=["lat"]).collect()} == {("f", 2.0), ("g", 9.0)}


def test_high_water_mark_golden(spark):
    df = spark.createDataFrame(
        [(19649, dt.datetime(2019, 1, 10, 19, 5, 56)), (19649, dt.datetime(2019, 11, 3, 23, 58, 34)), (5, None)],
        "sensor_id bigint, timestamp timestamp",
    )
    assert [tuple(r) for r in aggregates.high_water(df, "sensor_id").collect()] == [(19649, dt.date(2019, 11, 4))]


def test_constant_target_scales_by_one(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1), 3.0)] * 3, "timestamp timestamp, P1 double")
    assert aggregates.fit_target(df).first()["sd"] == 1.0


def test_grid_is_half_open(spark):
    e = spark.createDataFrame([(0.0, 0.05, 0.0, 0.02)], "lon_min double, lon_max double, lat_min double, lat_max double")
    got = {tuple(r) for r in joins.map_grid(e).collect()}
    assert got == {(0.0, 0.0), (0.025, 0.0), (0.0, 0.0125), (0.025, 0.0125)}
    point = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "lon_min double, lon_max double, lat_min double, lat_max double")
    assert joins.map_grid(point).count() == 0


def moved_after_filling(df):
    """Lines of the plan that move rows out of a generator: over the network or to the driver and back."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+*-]*(\(\d+\) )?", line).group(0).split("(")[0].rstrip("* ")) for line in lines]
    found = []
    for k, line in enumerate(lines):
        below = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        if "Exchange" in line and any("Generate" in under for under in lines[k + 1:below]):
            found.append(line.strip())
    return found


@pytest.fixture(scope="module")
def gappy(spark):
    """Dust and weather readings with gaps, in and out of each other's hours, and pairs: two partners, a copy, unknown ids."""
    t = dt.datetime(2021, 1, 1)
    dust = [(1, 0, 1.0), (1, 0, 2.0), (1, 5, 3.0), (1, 6, None), (2, 3, 4.0), (3, 1, 5.0), (3, 30, 6.0), (None, 2, 7.0), (4, 0, 8.0)]
    meteo = [(10, 1, 1.0), (10, 5, 2.0), (10, 9, 3.0), (11, 0, 4.0), (11, 4, None), (11, 6, 6.0), (12, 3, 7.0), (None, 3, 8.0), (12, 90, 9.0)]
    pairs = [(1, 10, 1.5), (1, 11, 2.5), (2, 12, 3.5), (2, 12, 4.5), (3, None, 5.5), (3, 12, None), (None, 10, 6.5), (9, 11, 7.5)]
    at = lambda rows: [(i, t + dt.timedelta(hours=h, minutes=7 * k), v) for k, (i, h, v) in enumerate(rows)]
    return (
        spark.createDataFrame(at(dust), "sds_sensor bigint, ts timestamp, P1 double"),
        spark.createDataFrame(at(meteo), "bme_sensor bigint, ts timestamp, pressure double"),
        spark.createDataFrame(pairs, "sds_sensor bigint, bme_sensor bigint, lat double"),
    )


def test_filling_after_the_pairing_gives_the_same_rows(gappy):
    dust, meteo, pairs = gappy
    d, m = resample.hourly_mean(dust, ["sds_sensor"]), resample.hourly_mean(meteo, ["bme_sensor"])
    filled_first = joins.attach_meteo(d, m, pairs, ["pressure"], ["lat"])
    plain = d.join(pairs, "sds_sensor").join(m, ["bme_sensor", "hour"], "left").select(filled_first.columns)
    d, m = resample.hourly_mean(dust, ["sds_sensor"], fill=False), resample.hourly_mean(meteo, ["bme_sensor"], fill=False)
    filled_last = joins.attach_meteo(d, m, pairs, ["pressure"], ["lat"], ["P1"])
    assert filled_last.columns == filled_first.columns
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(filled_last) == rows(filled_first) == rows(plain)
    assert plain.count() == 7 * 2 + 2 + 30 * 2


def test_filled_hours_are_neither_broadcast_nor_shuffled(spark, sf, gappy):
    import __spark_entry__ as entry

    assert moved_after_filling(entry.queries()["j2_dust_with_paired_meteo"](spark, sf)) == []
    dust, meteo, pairs = gappy
    joined = joins.attach_meteo(
        resample.hourly_mean(dust, ["sds_sensor"]), resample.hourly_mean(meteo, ["bme_sensor"]), pairs, ["pressure"]
    )
    assert not [line for line in moved_after_filling(joined) if "Broadcast" in line]
