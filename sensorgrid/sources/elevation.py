"""Ground elevation from JSON responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.schemas import ELEVATION_RESPONSE


def parse_elevation(responses: DataFrame, body: str = "body", order: str | None = None) -> DataFrame:
    """``lat, lon, elevation`` from response texts; the last entry of a place wins.

    ``order`` names the column that puts several responses in order.
    """
    seq = F.col(order) if order else F.lit(0)
    items = responses.select(
        seq.alias("_seq"), F.posexplode(F.from_json(F.col(body), ELEVATION_RESPONSE)["results"]).alias("_pos", "_r")
    ).select(
        "_seq",
        "_pos",
        F.col("_r.location.lat").alias("lat"),
        F.col("_r.location.lng").alias("lon"),
        F.col("_r.elevation").alias("elevation"),
    )
    return items.groupBy("lat", "lon").agg(F.max_by("elevation", F.struct("_seq", "_pos")).alias("elevation"))


def request_payload(chunks: DataFrame) -> DataFrame:
    """``lat,lon|lat,lon|...`` text per chunk of places (``items`` of struct<lat,lon>)."""
    place = lambda p: F.concat_ws(",", p["lat"].cast("string"), p["lon"].cast("string"))
    return chunks.select("chunk", F.array_join(F.transform("items", place), "|").alias("payload"))
