import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from sensorgrid import config
from sensorgrid.functions import geo, scalar, text


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, want",
    [("1.5", 1.5), (" 2 ", 2.0), ("", None), ("abc", None), ("nan", None), ("1.5f", None), ("3d", None), ("1e3", 1000.0), (None, None)],
)
def test_to_number(spark, raw, want):
    assert one(spark, scalar.to_number(F.lit(raw).cast("string"))) == want


def test_times(spark):
    assert one(spark, scalar.to_time(F.lit("2019-01-10T19:05:56"))) == dt.datetime(2019, 1, 10, 19, 5, 56)
    assert one(spark, scalar.to_time(F.lit("yesterday-ish"))) is None
    assert one(spark, scalar.station_time(F.lit("08.12.2019 21:00"))) == dt.datetime(2019, 12, 8, 21)
    assert one(spark, scalar.station_day(F.lit("09.12.2019 21:00"))) == dt.date(2019, 12, 9)
    assert one(spark, scalar.to_utc(F.lit("2019-04-04 03:00:00").cast("timestamp"), config.STATION_ZONE)) == dt.datetime(2019, 4, 4)
    start = F.lit("2021-03-01").cast("timestamp")
    assert one(spark, scalar.hours_since(F.lit("2021-03-02 12:30:00").cast("timestamp"), start)) == 36.5
    d = lambda s: F.lit(s).cast("date")
    assert len(one(spark, scalar.days_between(d("2019-12-04"), d("2019-12-05")))) == 2
    assert one(spark, scalar.days_between(d("2019-12-06"), d("2019-12-05"))) == []


def test_null_rules(spark):
    nothing = F.lit(None).cast("double")
    assert one(spark, scalar.floor_at(nothing)) is None
    assert [one(spark, scalar.floor_at(F.lit(v))) for v in (0.2, 1.0, 1.5)] == [1.0, 1.0, 1.5]
    assert [one(spark, scalar.half_even(F.lit(v))) for v in (0.5, 1.5, 2.5, 12.5)] == [0.0, 2.0, 2.0, 12.0]
    assert one(spark, scalar.nan_to_null(F.lit(float("nan")))) is None
    assert one(spark, scalar.unit_if_zero(F.lit(0.0))) == 1.0
    assert one(spark, scalar.later_of(F.lit("2020-01-02"), F.lit(None).cast("string"))) == "2020-01-02"


def test_standardise_round_trip(spark):
    z = scalar.standardise_log(F.lit(7.0), F.lit(1.2), F.lit(0.4))
    assert one(spark, scalar.unstandardise_log(z, F.lit(1.2), F.lit(0.4))) == pytest.approx(7.0)


def test_file_names_and_urls(spark):
    url = one(spark, text.archive_url(F.lit(111), F.lit("2019-12-05").cast("date"), F.lit("type")))
    assert url == "https://archive.sensor.community/2019-12-05/2019-12-05_type_sensor_111.csv"
    assert tuple(one(spark, text.stored_file_sensor(F.lit("19649_sds011_sensor_.csv")))) == (19649, "SDS011")
    assert tuple(one(spark, text.archive_file_sensor(F.lit("_bme280_sensor_141.csv")))) == (141, "bme280")
    assert one(spark, text.stored_file_name(F.lit(7), F.lit("sds011"))) == "7_sds011_sensor_.csv"
    assert one(spark, text.after_date(F.lit("2019-12-02_csv1"))) == "_csv1"
    assert one(spark, text.after_date(F.lit("2019-12-02"))) == ""
    assert one(spark, text.last_path_part(F.lit("http://a/b/c.csv"))) == "c.csv"


def test_archive_link(spark):
    script = """
    <script type="text/javascript">
        $("#f_result").empty().append('
        <a href=http://37.9.3.253/download/files.synop/27/../27605.29.10.2020.31.10.2020.1.0.0.ru.utf8.00000000.csv.gz>
        text</a>').css("display","none");
    </script>"""
    assert one(spark, text.archive_link(F.lit(script))) == (
        "http://37.9.3.253/download/files.synop/27/27605.29.10.2020.31.10.2020.1.0.0.ru.utf8.00000000.csv.gz"
    )


def test_tokens_and_roles(spark):
    assert one(spark, text.first_number(F.lit(" \n 5.5 mm"))) == 5.5
    assert one(spark, text.first_number(F.lit("x 5"))) is None
    assert one(spark, text.first_token(F.lit("  "))) is None
    assert one(spark, text.row_role(F.lit("Ветер: скорость"))) == "wind_speed"
    assert one(spark, text.row_role(F.lit("Ветер, направление"))) == "wind_dir"
    assert one(spark, text.row_role(F.lit("другое"))) is None


def test_mercator(spark):
    assert one(spark, geo.mercator_y(F.lit(45.0))) == pytest.approx(5591295.92, abs=0.01)
    assert one(spark, geo.mercator_x(F.lit(180.0))) == pytest.approx(math.pi * 6378137.0)
    assert one(spark, geo.haversine_m(F.lit(55.0), F.lit(37.0), F.lit(56.0), F.lit(37.0))) == pytest.approx(111195, abs=5)


def test_area_centroid_and_segment(spark):
    far = 1e7
    pts = [(0, 0), (4, 0), (4, 2), (0, 2)]
    ring = F.array(*[F.struct(F.lit(far + x).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])
    assert one(spark, geo.ring_area(ring)) == pytest.approx(8.0)
    assert one(spark, geo.signed_area(F.reverse(ring))) == pytest.approx(-8.0)
    assert tuple(one(spark, geo.ring_centroid(ring))) == pytest.approx((far + 2, 1.0))
    line = F.slice(ring, 1, 2)
    assert tuple(one(spark, geo.ring_centroid(line))) == pytest.approx((far + 2, 0.0))
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geo.segment_distance(*lit(1, 1, 0, 0, 4, 0))) == 1.0
    assert one(spark, geo.segment_distance(*lit(7, 4, 0, 0, 4, 0))) == 5.0
    assert one(spark, geo.segment_distance(*lit(3, 4, 0, 0, 0, 0))) == 5.0
