"""Map features by tag from a feature table ``feature_id, kind, tags, ring`` and, for relations, ``rings``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import PARK_MIN_AREA_M2
from sensorgrid.operators.nearest import larger_than

# --- fixed values: tag -> accepted values ------------------------------------------
PARK_TAGS = {"leisure": ["park", "garden"], "natural": ["wood"]}
ROAD_TAGS = {"highway": ["trunk", "primary", "secondary"]}
INDUSTRIAL_TAGS = {"landuse": ["industrial"]}
# -----------------------------------------------------------------------------


def tagged(tags: dict[str, list[str]], column: str = "tags") -> Column:
    """True where any of the tags has one of its accepted values."""
    cond = F.lit(False)
    for key, values in tags.items():
        cond = cond | F.coalesce(F.try_element_at(F.col(column), F.lit(key)).isin(*values), F.lit(False))
    return cond


def split_features(features: DataFrame, min_area: float = PARK_MIN_AREA_M2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(parks, roads, industrial)``; parks are ways or relations over ``min_area``."""
    parks = features.filter(tagged(PARK_TAGS) & F.col("kind").isin("way", "relation"))
    return (
        larger_than(parks, min_area),
        features.filter(tagged(ROAD_TAGS)),
        features.filter(tagged(INDUSTRIAL_TAGS)),
    )
