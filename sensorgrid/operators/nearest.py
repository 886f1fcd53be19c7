"""Exact distance to the nearest feature, by descent through a tree of cells.

Features (points or segments) hang in a grid tree by their midpoint: every level
cuts a cell into 16 x 16.  A tree node keeps the bounding box of what it holds.  All
points walk down together, one equi-join per level: a point keeps a node only if
the node's nearest possible distance does not exceed the least of the farthest
possible distances seen for that point.  No feature that could be nearest is ever
dropped, so the result is exact, and a node fans out to at most 256 children however
dense the data is.  Copies of a place are folded before the walk.

Features and tree are written once to the shared folder, the tree by level: each step
then reads its level only, and a lost executor costs no recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.config import MAP_BOX, PARK_MIN_AREA_M2, Box
from sensorgrid.functions import geo
from sensorgrid.operators.select import inside
from sensorgrid.session import stored

BITS = 4  # 16 x 16 children per node
BROADCAST_LEVELS = 2  # at most 256 ** 2 = 65,536 nodes per kind, about 5 MB
MAX_LEVELS = 7  # 100 km / 16 ** 7 = 0.4 mm; cell numbers of an axis fit into 31 bits
WALK_ROWS = 1 << 19  # rows a task sorts for one level of the walk, at a full fan-out of one node per place and kind
LEAF_ROWS = 64  # the tree is deepened until no leaf holds more features


def _node(cx: Column, cy: Column, up: int) -> Column:
    """Key of the ancestor ``up`` levels over the leaf cell (cx, cy)."""
    return F.shiftleft(F.shiftright(cx, BITS * up), 31).bitwiseOR(F.shiftright(cy, BITS * up))


def _parent(node: Column) -> Column:
    cx, cy = F.shiftright(node, 31), node.bitwiseAND(F.lit((1 << 31) - 1))
    return _node(cx, cy, 1)


def _depth(features: DataFrame, cx: Column, cy: Column) -> int:
    """Least number of levels at which no leaf holds more than ``LEAF_ROWS`` features."""
    nodes = F.array(*[
        F.struct(F.lit(level).alias("level"), _node(cx, cy, MAX_LEVELS - level).alias("node"))
        for level in range(1, MAX_LEVELS + 1)
    ])
    fullest = (
        features.select("kind", F.explode(nodes).alias("_n"))
        .groupBy("_n.level", "kind", "_n.node")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("level")
        .agg(F.max("rows").alias("rows"))
        .collect()
    )
    return min((r["level"] for r in fullest if r["rows"] <= LEAF_ROWS), default=MAX_LEVELS)


def _box() -> list[Column]:
    return [F.col(c) for c in ("bx0", "by0", "bx1", "by1")]


def nearest_distances(
    places: DataFrame, features: DataFrame, kinds: Sequence[str], levels: int | None = None
) -> DataFrame:
    """Distance from every distinct place to the nearest feature of every kind.

    ``places``: ``x, y``.  ``features``: ``kind, ax, ay, bx, by``, a point feature having
    both ends equal.  Returns ``x, y`` and one column per kind, NULL for a kind
    without features.  The depth follows from the densest spot unless ``levels`` is given.
    """
    if levels is not None and not 1 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels must be between 1 and {MAX_LEVELS}")
    features = stored(
        features.select("kind", "ax", "ay", "bx", "by").filter(F.col("kind").isin(*kinds)).na.drop().distinct(),
        "features",
    )
    mx, my = (F.col("ax") + F.col("bx")) / 2.0, (F.col("ay") + F.col("by")) / 2.0
    x0, y0, width, height = features.agg(
        F.min(mx), F.min(my), F.max(mx) - F.min(mx), F.max(my) - F.min(my)
    ).first()
    side = max(width or 0.0, height or 0.0) or 1.0
    cells = 1 << (BITS * MAX_LEVELS)

    def finest(mid: Column, low: float | None) -> Column:
        place = F.floor((mid - F.lit(low or 0.0)) / F.lit(side) * F.lit(float(cells)))
        return F.least(place, F.lit(cells - 1)).cast("bigint")

    levels = levels or _depth(features, finest(mx, x0), finest(my, y0))
    to_leaf = BITS * (MAX_LEVELS - levels)
    cx, cy = F.shiftright(finest(mx, x0), to_leaf), F.shiftright(finest(my, y0), to_leaf)
    hung = features.withColumn("node", _node(cx, cy, 0))
    ancestors = F.array(*[
        F.struct(F.lit(level).alias("level"), _node(cx, cy, levels - level).alias("node"))
        for level in range(1, levels + 1)
    ])
    # Boxes of all nodes of all levels, built in one pass and written once.
    tree = stored(
        features.withColumn("_a", F.explode(ancestors))
        .groupBy("_a.level", "kind", "_a.node")
        .agg(
            F.min(F.least("ax", "bx")).alias("bx0"),
            F.min(F.least("ay", "by")).alias("by0"),
            F.max(F.greatest("ax", "bx")).alias("bx1"),
            F.max(F.greatest("ay", "by")).alias("by1"),
        )
        .withColumn("up", _parent(F.col("node"))),
        "feature-tree",
        partition_by="level",
    )

    # Places are spread once, by a whole-number key; every window below keeps to it.  Their few bytes say nothing
    # of the rows they fan out to, so the number of tasks follows from their count.
    spots = stored(places.select("x", "y").na.drop().distinct(), "places")
    fan_out = spots.count() * len(kinds) << (2 * BITS)
    walk = (
        spots.withColumn("place", F.xxhash64("x", "y"))
        .repartition(max(spots.sparkSession.sparkContext.defaultParallelism, -(-fan_out // WALK_ROWS)), "place")
        .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
        .withColumn("node", F.lit(0).cast("bigint"))
    )
    per_place = Window.partitionBy("place", "x", "y", "kind")
    for level in range(1, levels + 1):
        children = tree.filter(F.col("level") == level).drop("level")
        if level <= BROADCAST_LEVELS:
            children = F.broadcast(children)
        walk = (
            walk.withColumnRenamed("node", "up")
            .join(children, ["kind", "up"])
            .withColumn("_near", geo.box_near("x", "y", *_box()))
            .withColumn("_reach", F.min(geo.box_far("x", "y", *_box())).over(per_place))
            .filter(F.col("_near") <= F.col("_reach") * F.lit(1.0 + 1e-12) + F.lit(1e-9))
            .select("place", "x", "y", "kind", "node")
        )
    distance = geo.segment_distance("x", "y", "ax", "ay", "bx", "by")
    found = walk.join(hung, ["kind", "node"]).withColumn("_d", distance)
    return found.groupBy("place", "x", "y").agg(
        *[F.min(F.when(F.col("kind") == k, F.col("_d"))).alias(k) for k in kinds]
    ).drop("place")


# --- map features -------------------------------------------------------------------
def point_features(df: DataFrame, kind: str, x: Column, y: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), x.alias("ax"), y.alias("ay"), x.alias("bx"), y.alias("by"))


def feature_rings(features: DataFrame) -> Column:
    """Projected rings of every feature: its ``rings`` where it has them, else its one ``ring``."""
    role = F.struct(F.lit("outer").alias("role"), F.col("ring").alias("ring"))
    rings = F.coalesce(F.col("rings"), F.array(role)) if "rings" in features.columns else F.array(role)
    return geo.project_rings(rings)


MEASURED = ["area_m2", "centre_x", "centre_y"]


def measured(areas: DataFrame) -> DataFrame:
    """Areas with ``area_m2, centre_x, centre_y``, holes and all parts counted; each ring is projected and summed once.

    A generator, which is not repeated in the filters and projections over it.
    """
    if set(MEASURED) <= set(areas.columns):
        return areas
    return areas.select("*", F.inline(F.array(geo.rings_measure(feature_rings(areas)))).alias(*MEASURED))


def centroid_features(areas: DataFrame, kind: str) -> DataFrame:
    """Centroids of areas as point features."""
    return point_features(measured(areas), kind, F.col("centre_x"), F.col("centre_y"))


def line_features(lines: DataFrame, kind: str) -> DataFrame:
    """Segments of every line of the features; a line of one vertex is a point."""
    xy = lines.select(F.explode(feature_rings(lines)).alias("_r")).select(F.col("_r.ring").alias("_l"))
    ends = F.arrays_zip(
        F.col("_l").alias("a"),
        F.concat(F.slice("_l", 2, F.size("_l")), F.slice("_l", -1, 1)).alias("b"),
    )
    # The last vertex paired with itself is dropped unless it is the only one.
    pairs = F.when(F.size("_l") > 1, F.slice(ends, 1, F.size("_l") - 1)).otherwise(ends)
    return xy.select(F.explode(pairs).alias("_s")).select(
        F.lit(kind).alias("kind"),
        F.col("_s")["a"]["x"].alias("ax"), F.col("_s")["a"]["y"].alias("ay"),
        F.col("_s")["b"]["x"].alias("bx"), F.col("_s")["b"]["y"].alias("by"),
    )


def larger_than(areas: DataFrame, min_area: float = PARK_MIN_AREA_M2) -> DataFrame:
    """Areas over ``min_area`` projected square metres, less their holes, with the columns of :func:`measured`."""
    return measured(areas).filter(F.col("area_m2") > min_area)


def attach_nearest(
    sensors: DataFrame,
    parks: DataFrame,
    roads: DataFrame,
    industrial: DataFrame,
    box: Box = MAP_BOX,
    levels: int | None = None,
) -> DataFrame:
    """Sensors inside ``box`` with ``nearest_park, nearest_road, nearest_indust`` in metres.

    Parks and industrial areas count by centroid, roads by their course.
    """
    kinds = ["nearest_park", "nearest_road", "nearest_indust"]
    features = (
        centroid_features(parks, kinds[0])
        .unionByName(line_features(roads, kinds[1]))
        .unionByName(centroid_features(industrial, kinds[2]))
    )
    located = (
        inside(sensors, box)
        .withColumn("x", geo.mercator_x("lon"))
        .withColumn("y", geo.mercator_y("lat"))
    )
    return located.join(nearest_distances(located, features, kinds, levels), ["x", "y"], "left").drop("x", "y")
