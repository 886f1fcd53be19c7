import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import geo
from sensorgrid.operators import nearest


def brute(points, segs):
    out = []
    for px, py in points:
        best = np.inf
        for ax, ay, bx, by in segs:
            dx, dy = bx - ax, by - ay
            l2 = dx * dx + dy * dy
            t = 0.0 if l2 == 0 else min(1, max(0, ((px - ax) * dx + (py - ay) * dy) / l2))
            best = min(best, np.hypot(px - ax - t * dx, py - ay - t * dy))
        out.append(best)
    return np.array(out)


@pytest.mark.parametrize("levels", [1, 3, 7, None])
def test_tree_equals_brute_force(spark, levels):
    rng = np.random.default_rng(1)
    pts = rng.uniform(-2000, 12000, (150, 2))
    pts[:50] = rng.normal(5000, 3, (50, 2))  # a dense knot of places
    segs = np.concatenate([
        np.repeat(rng.normal(5000, 2, (80, 2)), 2, axis=0).reshape(80, 4),  # dense point features
        rng.uniform(0, 10000, (60, 4)),  # long segments
    ])
    far = rng.uniform(0, 10000, (40, 2))
    feats = [("s", *map(float, s)) for s in segs] + [("p", float(a), float(b), float(a), float(b)) for a, b in far]
    f = spark.createDataFrame(feats + feats[:20], "kind string, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    got = nearest.nearest_distances(p, f, ["s", "p", "none"], levels).toPandas()
    want_s = {tuple(k): v for k, v in zip(pts, brute(pts, segs))}
    want_p = {tuple(k): v for k, v in zip(pts, brute(pts, np.hstack([far, far])))}
    assert len(got) == len(pts)
    for r in got.itertuples():
        assert r.s == pytest.approx(want_s[(r.x, r.y)], abs=1e-9)
        assert r.p == pytest.approx(want_p[(r.x, r.y)], abs=1e-9)
        assert np.isnan(r.none) or r.none is None


def test_more_places_walk_in_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(nearest, "WALK_ROWS", 4 * 256)
    p = spark.range(500).select((F.col("id") % 100).cast("double").alias("x"), F.lit(0.0).alias("y"))
    f = spark.createDataFrame([("g", 3.0, 4.0, 3.0, 4.0)], "kind string, ax double, ay double, bx double, by double")
    out = nearest.nearest_distances(p, f, ["g"])
    # 100 places of one kind, four to a task; adaptive execution may not merge tasks of a given number.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(place#\d+L, 25\), REPARTITION_BY_NUM", plan)
    got = {r["x"]: r["g"] for r in out.collect()}
    assert len(got) == 100 and got[3.0] == 4.0 and got[0.0] == 5.0


def test_single_feature_and_golden_point(spark):
    f = spark.createDataFrame(
        [("g", 0.0, 1.45, 0.0, 1.45), ("g", 2.0, 2.0, 2.0, 2.0), ("g", 0.0, 2.5, 0.0, 2.5)],
        "kind string, ax double, ay double, bx double, by double",
    )
    p = spark.createDataFrame([(1.0, 1.67)], "x double, y double")
    d = nearest.nearest_distances(p, f, ["g"]).first()["g"]
    assert d == pytest.approx(np.hypot(1.0, 0.22))
    one = nearest.nearest_distances(p, f.limit(1), ["g"]).first()["g"]
    assert one == pytest.approx(np.hypot(1.0, 0.22))


def test_attach_nearest_keeps_box_and_columns(spark):
    sensors = spark.createDataFrame([(55.0, 36.0), (57.0, 37.5), (59.5, 38.5)], "lat double, lon double")
    sq = lambda lon, lat, d: [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    ring = "array<struct<lon:double,lat:double>>"
    park = spark.createDataFrame([(sq(37.4, 57.0, 0.1),), (sq(37.5, 57.0, 0.0001),)], f"ring {ring}")
    road = spark.createDataFrame([([(37.0, 57.1), (38.0, 57.1)],)], f"ring {ring}")
    big = nearest.larger_than(park)
    assert big.count() == 1
    out = nearest.attach_nearest(sensors, big, road, park).collect()
    assert len(out) == 1
    row = out[0]
    want = spark.range(1).select(
        (geo.mercator_y(F.lit(57.1)) - geo.mercator_y(F.lit(57.0))).alias("d")
    ).first()["d"]
    assert row["nearest_road"] == pytest.approx(want)
    assert row["nearest_park"] > row["nearest_indust"] > 0


def test_features_of_several_rings(spark):
    sq = lambda lon, lat, d: [(lon, lat), (lon + d, lat), (lon + d, lat + d), (lon, lat + d)]
    pts = "array<struct<lon:double,lat:double>>"
    rows = [
        ("whole", sq(10.0, 0.0, 0.4), None),
        ("holed", None, [("outer", sq(10.0, 0.0, 0.4)), ("inner", sq(10.2, 0.0, 0.2)[::-1])]),
        ("parts", None, [("outer", sq(10.0, 0.0, 0.2)), ("outer", sq(11.0, 0.0, 0.2)[::-1])]),
    ]
    f = spark.createDataFrame(rows, f"name string, ring {pts}, rings array<struct<role:string,ring:{pts}>>")
    got = {r["name"]: r for r in f.select("name", geo.rings_area(nearest.feature_rings(f)).alias("a"), geo.rings_centroid(
        nearest.feature_rings(f)).alias("c")).collect()}
    metre = np.radians(0.1) * geo.SEMI_MAJOR_M
    # On the equator a tenth of a degree of latitude has about 0.9933 of the metres of one of longitude.
    assert got["whole"]["a"] == pytest.approx(16 * 0.9933 * metre**2, rel=1e-3)
    assert got["holed"]["a"] == pytest.approx(12 * 0.9933 * metre**2, rel=1e-3)
    assert got["parts"]["a"] == pytest.approx(8 * 0.9933 * metre**2, rel=1e-3)
    assert got["whole"]["c"]["x"] == pytest.approx(102 * metre)
    assert got["holed"]["c"]["x"] == pytest.approx((16 * 102 - 4 * 103) / 12 * metre, rel=1e-6)
    assert got["holed"]["c"]["y"] == pytest.approx((16 * 2 - 4 * 1) / 12 * 0.9933 * metre, rel=1e-3)
    assert got["parts"]["c"]["x"] == pytest.approx(106 * metre)
    big = nearest.larger_than(f, 14 * 0.9933 * metre**2)
    assert [r["name"] for r in big.collect()] == ["whole"]
    lines = nearest.line_features(f.filter("name = 'parts'"), "road")
    assert lines.count() == 6 and lines.filter(F.abs(F.col("ax") - F.col("bx")) > 5 * metre).count() == 0
