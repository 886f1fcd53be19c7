"""Projection, shapes, hexagons and the nearest feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import labelled, pairs, place_lat, place_lon, place_sql, query, rounded, table
from sensorgrid.functions import geo
from sensorgrid.operators import aggregates, nearest
from sensorgrid.sources import features as feature_source

_E = "0.08181919084262149::DOUBLE"
_MX = "6378137.0::DOUBLE * radians({lon})"
_MY = (
    "6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({lat}) / 2) * pow((1 - " + _E + " * sin(radians({lat}))) / (1 + " + _E
    + " * sin(radians({lat}))), " + _E + " / 2))"
)


def mercator_sql(lon: str, lat: str) -> tuple[str, str]:
    return _MX.format(lon=lon), _MY.format(lat=lat)


# Map features from the parts: the type says which tag a part stands for.
SHAPES = f"""
base AS (SELECT p_partkey AS feature_id, p_type, p_size / 2000.0::DOUBLE AS d, {place_sql('p_partkey')} FROM part),
verts AS (SELECT feature_id, p_type, 0 AS i, lon, lat FROM base UNION ALL SELECT feature_id, p_type, 1, lon + d, lat FROM base
UNION ALL SELECT feature_id, p_type, 2, lon + d, lat + d FROM base UNION ALL SELECT feature_id, p_type, 3, lon, lat + d / 2 FROM base),
xy AS (SELECT feature_id, p_type, i, {_MX.format(lon='lon')} AS x, {_MY.format(lat='lat')} AS y FROM verts),
edge AS (SELECT a.feature_id, a.p_type, a.i, a.x - o.x AS x0, a.y - o.y AS y0, b.x - o.x AS x1, b.y - o.y AS y1, o.x AS ox, o.y AS oy
FROM xy a JOIN xy b ON a.feature_id = b.feature_id AND b.i = (a.i + 1) % 4 JOIN xy o ON o.feature_id = a.feature_id AND o.i = 0),
shape AS (SELECT feature_id, any_value(p_type) AS p_type, sum(x0 * y1 - x1 * y0) / 2 AS area,
any_value(ox) + sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cx,
any_value(oy) + sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cy FROM edge GROUP BY 1)
"""


def shapes(spark, sf):
    """``feature_id, kind, tags, ring`` of quadrilaterals at the places of the parts."""
    d = F.col("p_size") / F.lit(2000.0)
    lon, lat = place_lon(F.col("p_partkey")), place_lat(F.col("p_partkey"))

    def vertex(x, y):
        return F.struct(x.alias("lon"), y.alias("lat"))

    tag = F.expr(
        "map_from_arrays(array(CASE p_type WHEN 'ECONOMY' THEN 'leisure' WHEN 'SMALL' THEN 'natural' WHEN 'MEDIUM' THEN 'highway' "
        "WHEN 'LARGE' THEN 'landuse' ELSE 'name' END), array(CASE p_type WHEN 'ECONOMY' THEN 'park' WHEN 'SMALL' THEN 'wood' "
        "WHEN 'MEDIUM' THEN 'primary' WHEN 'LARGE' THEN 'industrial' ELSE 'x' END))"
    )
    ring = F.array(vertex(lon, lat), vertex(lon + d, lat), vertex(lon + d, lat + d), vertex(lon, lat + d / 2))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("feature_id"), F.lit("way").alias("kind"), tag.alias("tags"), ring.alias("ring")
    )


@query(
    "g1_world_mercator",
    f"SELECT sds_sensor, timestamp, round({_MX.format(lon='lon')}, 4) AS x, round({_MY.format(lat='lat')}, 4) AS y FROM labelled",
    "labelled",
)
def mercator(spark, sf):
    return rounded(
        labelled(spark, sf).select("sds_sensor", "timestamp", geo.mercator_x("lon").alias("x"), geo.mercator_y("lat").alias("y")), 4
    )


@query(
    "g2_area_and_centroid",
    f"WITH {SHAPES.strip()} SELECT feature_id, round(abs(area), 1) AS area, round(cx, 3) AS cx, round(cy, 3) AS cy FROM shape",
)
def shape_measures(spark, sf):
    xy = shapes(spark, sf).select("feature_id", geo.project_ring("ring").alias("xy"))
    c = xy.select("feature_id", geo.ring_area("xy").alias("area"), geo.ring_centroid("xy").alias("c"))
    out = c.select("feature_id", "area", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))
    return rounded(rounded(out, 1, "area"), 3, "cx", "cy")


_PX, _PY = mercator_sql("37.6::DOUBLE", "55.75::DOUBLE")
G3_SQL = f"""
WITH {SHAPES.strip()}, p AS (SELECT {_PX} AS px, {_PY} AS py),
s AS (SELECT a.feature_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, px, py FROM xy a JOIN xy b ON a.feature_id = b.feature_id AND a.i = 0 AND b.i = 2, p),
t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t FROM s)
SELECT feature_id, round(sqrt(pow(px - ax, 2) + pow(py - ay, 2)), 4) AS to_start,
round(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2)), 4) AS to_line FROM t
"""


@query("g3_point_and_line_distance", G3_SQL)
def distances(spark, sf):
    """From the city centre to the first corner and to the diagonal of every shape."""
    px, py = geo.mercator_x(F.lit(37.6)), geo.mercator_y(F.lit(55.75))
    xy = shapes(spark, sf).select("feature_id", geo.project_ring("ring").alias("r"))
    a, b = F.col("r")[0], F.col("r")[2]
    return rounded(xy.select(
        "feature_id", geo.point_distance(px, py, a["x"], a["y"]).alias("to_start"),
        geo.segment_distance(px, py, a["x"], a["y"], b["x"], b["y"]).alias("to_line"),
    ), 4)


@query(
    "f15_large_parks",
    f"WITH {SHAPES.strip()} SELECT feature_id, round(abs(area), 1) AS area FROM shape WHERE p_type IN ('ECONOMY', 'SMALL') AND abs(area) > 100000",
)
def large_parks(spark, sf):
    parks, _, _ = feature_source.split_features(shapes(spark, sf))
    return rounded(parks.select("feature_id", F.col("area_m2").alias("area")), 1)


RELATIONS_SQL = f"""
WITH base AS (SELECT p_partkey AS feature_id, p_size / 2000.0::DOUBLE AS d, {place_sql('p_partkey')} FROM part WHERE p_type IN ('ECONOMY', 'SMALL')),
rings AS (SELECT feature_id, 0 AS r, 1.0 AS sign, lon, lat, d FROM base UNION ALL SELECT feature_id, 1, -1.0, lon + d / 4, lat + d / 8, d / 8 FROM base
UNION ALL SELECT feature_id, 2, 1.0, lon + d * 2, lat, d / 2 FROM base),
verts AS (SELECT feature_id, r, sign, 0 AS i, lon, lat FROM rings UNION ALL SELECT feature_id, r, sign, 1, lon + d, lat FROM rings
UNION ALL SELECT feature_id, r, sign, 2, lon + d, lat + d FROM rings UNION ALL SELECT feature_id, r, sign, 3, lon, lat + d / 2 FROM rings),
xy AS (SELECT feature_id, r, sign, i, {_MX.format(lon='lon')} AS x, {_MY.format(lat='lat')} AS y FROM verts),
edge AS (SELECT a.feature_id, a.r, a.sign, a.x - o.x AS x0, a.y - o.y AS y0, b.x - o.x AS x1, b.y - o.y AS y1, o.x AS ox, o.y AS oy
FROM xy a JOIN xy b ON a.feature_id = b.feature_id AND a.r = b.r AND b.i = (a.i + 1) % 4 JOIN xy o ON o.feature_id = a.feature_id AND o.r = a.r AND o.i = 0),
part_ AS (SELECT feature_id, any_value(sign) * abs(sum(x0 * y1 - x1 * y0)) / 2 AS area,
any_value(ox) + sum((x0 + x1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cx,
any_value(oy) + sum((y0 + y1) * (x0 * y1 - x1 * y0)) / (3 * sum(x0 * y1 - x1 * y0)) AS cy FROM edge GROUP BY feature_id, r)
SELECT feature_id, round(sum(area), 1) AS area, round(sum(area * cx) / sum(area), 2) AS cx, round(sum(area * cy) / sum(area), 2) AS cy
FROM part_ GROUP BY 1 HAVING sum(area) > 100000
"""


@query("g2_s12_relations_with_holes", RELATIONS_SQL)
def relations_with_holes(spark, sf):
    """Parks of two parts, one of them with a hole, over the least area."""
    d, lon, lat = F.col("p_size") / F.lit(2000.0), place_lon(F.col("p_partkey")), place_lat(F.col("p_partkey"))

    def ring(role, x, y, size):
        corners = [(x, y), (x + size, y), (x + size, y + size), (x, y + size / 2)]
        return F.struct(F.lit(role).alias("role"), F.array(*[F.struct(a.alias("lon"), b.alias("lat")) for a, b in corners]).alias("ring"))

    rings = F.array(ring("outer", lon, lat, d), ring("inner", lon + d / 4, lat + d / 8, d / 8), ring("outer", lon + d * 2, lat, d / 2))
    park = F.when(F.col("p_type") == "ECONOMY", F.create_map(F.lit("leisure"), F.lit("park"))).when(
        F.col("p_type") == "SMALL", F.create_map(F.lit("natural"), F.lit("wood")))
    relations = table(spark, sf, "part").select(
        F.col("p_partkey").alias("feature_id"), F.lit("relation").alias("kind"), park.alias("tags"),
        F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("ring"), rings.alias("rings"))
    parks, _, _ = feature_source.split_features(relations)
    return rounded(rounded(parks.select("feature_id", F.col("area_m2").alias("area"), F.col("centre_x").alias("cx"), F.col("centre_y").alias("cy")), 1, "area"), 2, "cx", "cy")


@query(
    "s12_features_by_tag",
    """SELECT p_partkey AS feature_id, CASE p_type WHEN 'MEDIUM' THEN 'road' ELSE 'industrial' END AS layer
    FROM part WHERE p_type IN ('MEDIUM', 'LARGE')""",
)
def by_tag(spark, sf):
    _, roads, industrial = feature_source.split_features(shapes(spark, sf))
    return roads.select("feature_id", F.lit("road").alias("layer")).unionByName(
        industrial.select("feature_id", F.lit("industrial").alias("layer"))
    )


J11_SQL = f"""
WITH {SHAPES.strip()},
s AS (SELECT sds_sensor, bme_sensor, lat, lon, {_MX.format(lon='lon')} AS px, {_MY.format(lat='lat')} AS py FROM pairs
WHERE lon BETWEEN 37.1::DOUBLE AND 38.05::DOUBLE AND lat BETWEEN 55.48::DOUBLE AND 59.03::DOUBLE),
park AS (SELECT px, py, min(sqrt(pow(px - cx, 2) + pow(py - cy, 2))) AS d FROM (SELECT DISTINCT px, py FROM s), shape
WHERE p_type IN ('ECONOMY', 'SMALL') AND abs(area) > 100000 GROUP BY 1, 2),
ind AS (SELECT px, py, min(sqrt(pow(px - cx, 2) + pow(py - cy, 2))) AS d FROM (SELECT DISTINCT px, py FROM s), shape WHERE p_type = 'LARGE' GROUP BY 1, 2),
seg AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM xy a JOIN xy b ON a.feature_id = b.feature_id AND b.i = a.i + 1 WHERE a.p_type = 'MEDIUM'),
rt AS (SELECT px, py, ax, ay, bx, by_, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) AS t
FROM (SELECT DISTINCT px, py FROM s), seg),
road AS (SELECT px, py, min(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (by_ - ay), 2))) AS d FROM rt GROUP BY 1, 2)
SELECT s.sds_sensor, s.bme_sensor, s.lat, s.lon, round(park.d, 4) AS nearest_park, round(road.d, 4) AS nearest_road, round(ind.d, 4) AS nearest_indust
FROM s JOIN park ON s.px = park.px AND s.py = park.py JOIN road ON s.px = road.px AND s.py = road.py JOIN ind ON s.px = ind.px AND s.py = ind.py
"""


@query("j11_nearest_features", J11_SQL, "pairs")
def nearest_features(spark, sf):
    parks, roads, industrial = feature_source.split_features(shapes(spark, sf))
    out = nearest.attach_nearest(pairs(spark, sf), parks, roads, industrial)
    return rounded(out, 4, "nearest_park", "nearest_road", "nearest_indust")


A14_SQL = """
WITH b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM labelled),
e AS (SELECT x0 - (x1 - x0) * 1e-9 AS x0, x1 + (x1 - x0) * 1e-9 AS x1, y0 - (y1 - y0) * 1e-9 AS y0, y1 + (y1 - y0) * 1e-9 AS y1 FROM b),
u AS (SELECT P1, P2, (lon - x0) / ((x1 - x0) / 30) AS u, (lat - y0) / ((y1 - y0) / 17) AS v FROM labelled, e),
d AS (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) AS d1,
pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2 FROM u)
SELECT CASE WHEN d1 < d2 THEN 0 ELSE 1 END::BIGINT AS lattice, (CASE WHEN d1 < d2 THEN round_even(u, 0) ELSE floor(u) END)::BIGINT AS ix,
(CASE WHEN d1 < d2 THEN round_even(v, 0) ELSE floor(v) END)::BIGINT AS iy, count(*) AS n, round(avg(P1), 6) AS P1, round(avg(P2), 6) AS P2
FROM d GROUP BY 1, 2, 3
"""


@query("a14_hexagon_mean", A14_SQL, "labelled")
def hexagons(spark, sf):
    return rounded(aggregates.hexagon_mean(labelled(spark, sf), ["P1", "P2"]))
