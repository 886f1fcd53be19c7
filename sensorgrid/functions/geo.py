"""World Mercator projection, ring area and centroid, planar distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: WGS84 ------------------------------------------------------
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1.0 / 298.257223563
EARTH_RADIUS_M = 6371008.8
# -----------------------------------------------------------------------------
ECCENTRICITY = math.sqrt(FLATTENING * (2.0 - FLATTENING))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mercator_x(lon) -> Column:
    return F.lit(SEMI_MAJOR_M) * F.radians(_col(lon))


def mercator_y(lat) -> Column:
    """Ellipsoidal Mercator northing in metres."""
    phi = F.radians(_col(lat))
    es = F.lit(ECCENTRICITY) * F.sin(phi)
    conformal = F.pow((F.lit(1.0) - es) / (F.lit(1.0) + es), F.lit(ECCENTRICITY / 2.0))
    return F.lit(SEMI_MAJOR_M) * F.ln(F.tan(F.lit(math.pi / 4.0) + phi / 2.0) * conformal)


def project_ring(ring) -> Column:
    """``array<struct<lon,lat>>`` to ``array<struct<x,y>>`` in metres."""
    return F.transform(
        _col(ring),
        lambda p: F.struct(
            mercator_x(p.getField("lon")).alias("x"), mercator_y(p.getField("lat")).alias("y")
        ),
    )


def _edges(ring: Column) -> Column:
    """Closed ring as an array of (x0, y0, x1, y1, cross) edges, around its first vertex.

    Working relative to a vertex keeps the shoelace sums of small rings far from
    the origin accurate.
    """
    o = F.element_at(ring, 1)
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def edge(a, b):
        x0, y0 = a.getField("x") - o.getField("x"), a.getField("y") - o.getField("y")
        x1, y1 = b.getField("x") - o.getField("x"), b.getField("y") - o.getField("y")
        return F.struct(
            x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), (x0 * y1 - x1 * y0).alias("cross")
        )

    return F.zip_with(ring, nxt, edge)


def _sum(edges: Column, term) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + term(e))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signed_area(ring) -> Column:
    """Shoelace area of projected ``array<struct<x,y>>``; counter-clockwise is positive."""
    return _let(_col(ring), lambda r: _sum(_edges(r), lambda e: e.getField("cross")) / F.lit(2.0))


def ring_area(ring) -> Column:
    return F.abs(signed_area(ring))


def _centroid(ring: Column, edges: Column) -> Column:
    zero = F.lit(0.0)
    start = F.struct(zero.alias("w"), zero.alias("x"), zero.alias("y"))

    def add(acc, e):
        cross = e.getField("cross")
        return F.struct(
            (acc.getField("w") + cross).alias("w"),
            (acc.getField("x") + (e.getField("x0") + e.getField("x1")) * cross).alias("x"),
            (acc.getField("y") + (e.getField("y0") + e.getField("y1")) * cross).alias("y"),
        )

    o, n = F.element_at(ring, 1), F.size(ring).cast("double")

    def vertex_mean(c: str) -> Column:
        # An empty ring has no centre.
        return F.try_divide(F.aggregate(ring, zero, lambda a, p: a + p.getField(c)), n)


    def place(acc):
        area3 = F.lit(3.0) * acc.getField("w")
        return F.struct(
            *[
                F.when(area3 != 0, o.getField(c) + acc.getField(c) / area3).otherwise(vertex_mean(c)).alias(c)
                for c in ("x", "y")
            ]
        )

    return F.aggregate(edges, start, add, place)


def ring_centroid(ring) -> Column:
    """Area centroid as ``struct<x,y>``; the vertex mean for a ring without area."""
    return _let(_col(ring), lambda r: _centroid(r, _edges(r)))


def project_rings(rings) -> Column:
    """``array<struct<role,ring>>`` with every ring projected to metres; rings without a vertex are left out."""
    return F.transform(
        F.filter(_col(rings), lambda r: F.size(r.getField("ring")) > 0),
        lambda r: F.struct(r.getField("role").alias("role"), project_ring(r.getField("ring")).alias("ring")),
    )


def _ring_sign(r: Column) -> Column:
    return F.when(r.getField("role") == "inner", F.lit(-1.0)).otherwise(F.lit(1.0))


def rings_area(rings) -> Column:
    """Area of the outer rings less that of the inner ones, whatever way round they run."""
    return F.aggregate(_col(rings), F.lit(0.0), lambda acc, r: acc + _ring_sign(r) * ring_area(r.getField("ring")))


def rings_centroid(rings) -> Column:
    """Area centroid of all rings as ``struct<x,y>``; the centroid of all vertices for rings without area."""

    def weighted(r):
        return F.struct((_ring_sign(r) * ring_area(r.getField("ring"))).alias("w"), ring_centroid(r.getField("ring")).alias("c"))

    def middle(parts: Column, vertices: Column) -> Column:
        o, n = F.try_element_at(parts, F.lit(1)).getField("c"), F.size(vertices).cast("double")
        total = _sum(parts, lambda p: p.getField("w"))

        # Moments around the first ring's centre; one ring keeps its own centroid to the last bit.
        def moment(c: str) -> Column:
            return _sum(parts, lambda p: p.getField("w") * (p.getField("c").getField(c) - o.getField(c)))

        return F.struct(*[
            F.when(total != 0, o.getField(c) + moment(c) / total)
            .otherwise(F.try_divide(_sum(vertices, lambda p: p.getField(c)), n)).alias(c)
            for c in ("x", "y")
        ])

    vertices = F.flatten(F.transform(_col(rings), lambda r: r.getField("ring")))
    return _let(F.transform(_col(rings), weighted), lambda parts: middle(parts, vertices))


def ring_moments(ring) -> Column:
    """``struct<w,x,y>`` of a projected ring: twice its signed area, and the sums whose sixths over the area are the centroid, around vertex 1."""
    r = _col(ring)
    o = F.element_at(r, 1)

    # The end of an edge and twice the area it spans with vertex 1; what the three sums need of it.
    def edge(a, b):
        cross = (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
        return F.struct((a["x"] + b["x"] - o["x"] * 2).alias("x"), (a["y"] + b["y"] - o["y"] * 2).alias("y"), cross.alias("w"))

    def add(acc, e):
        return F.struct((acc["w"] + e["w"]).alias("w"), (acc["x"] + e["x"] * e["w"]).alias("x"), (acc["y"] + e["y"] * e["w"]).alias("y"))

    zero = F.lit(0.0)
    edges = F.zip_with(r, F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)), edge)
    return F.aggregate(edges, F.struct(zero.alias("w"), zero.alias("x"), zero.alias("y")), add)


def rings_measure(rings) -> Column:
    """``struct<area,x,y>`` of projected rings, each ring looked at once: area less holes, and area centroid.

    Rings without area have the mean of all vertices as centroid.
    """
    def measured(r):
        return F.struct(r["role"].alias("role"), r["ring"].alias("ring"), ring_moments(r["ring"]).alias("m"))

    def add(acc, r):
        m, o = r["m"], F.element_at(r["ring"], 1)
        # Orientation does not matter: an outer ring adds its area, an inner one takes it away.
        turn = F.when(m["w"] < 0, -1.0).otherwise(1.0) * _ring_sign(r)
        return F.struct(
            (acc["area"] + turn * m["w"] / 2).alias("area"),
            (acc["x"] + turn * (m["x"] / 6 + o["x"] * m["w"] / 2)).alias("x"), (acc["y"] + turn * (m["y"] / 6 + o["y"] * m["w"] / 2)).alias("y"))

    def moved(parts):
        # Around the first vertex of the first ring, where sums keep their digits.
        at = F.try_element_at(parts, F.lit(1))["ring"][0]
        near = F.transform(parts, lambda r: F.struct(
            r["role"].alias("role"), F.array(F.struct(*[(r["ring"][0][c] - at[c]).alias(c) for c in ("x", "y")])).alias("ring"), r["m"].alias("m")))
        zero = F.lit(0.0)
        return F.struct(at.alias("at"), F.aggregate(near, F.struct(zero.alias("area"), zero.alias("x"), zero.alias("y")), add).alias("sum"),
                        F.flatten(F.transform(parts, lambda r: r["ring"])).alias("vertices"))

    def result(m):
        s, n = m["sum"], F.size(m["vertices"]).cast("double")
        place = [F.when(s["area"] != 0, m["at"][c] + s[c] / s["area"]).otherwise(F.try_divide(_sum(m["vertices"], _coordinate(c)), n)).alias(c) for c in ("x", "y")]
        return F.struct(s["area"].alias("area"), *place)

    return _let(_let(F.transform(_col(rings), measured), moved), result)


def _coordinate(c: str):
    return lambda p: p[c]


def point_distance(x0, y0, x1, y1) -> Column:
    return F.hypot(_col(x0) - _col(x1), _col(y0) - _col(y1))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance from a point to a segment; a segment of no length is a point."""
    px, py, ax, ay, bx, by = (_col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((px - ax) * dx + (py - ay) * dy) / length2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def box_near(px, py, x0, y0, x1, y1) -> Column:
    """Least distance from a point to an axis-parallel box."""
    px, py, x0, y0, x1, y1 = (_col(c) for c in (px, py, x0, y0, x1, y1))
    zero = F.lit(0.0)
    return F.hypot(F.greatest(x0 - px, zero, px - x1), F.greatest(y0 - py, zero, py - y1))


def box_far(px, py, x0, y0, x1, y1) -> Column:
    """Greatest distance from a point to an axis-parallel box."""
    px, py, x0, y0, x1, y1 = (_col(c) for c in (px, py, x0, y0, x1, y1))
    return F.hypot(F.greatest(px - x0, x1 - px), F.greatest(py - y0, y1 - py))


def haversine_m(lat0, lon0, lat1, lon1) -> Column:
    """Great-circle metres, for users who want true instead of Mercator metres."""
    a0, a1 = F.radians(_col(lat0)), F.radians(_col(lat1))
    dlat, dlon = a1 - a0, F.radians(_col(lon1)) - F.radians(_col(lon0))
    h = F.pow(F.sin(dlat / 2.0), 2.0) + F.cos(a0) * F.cos(a1) * F.pow(F.sin(dlon / 2.0), 2.0)
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
