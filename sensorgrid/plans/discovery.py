"""New sensors from archive listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import ARCHIVE_URL, DISCOVERY_BOX, Box
from sensorgrid.functions import text
from sensorgrid.operators import joins, select
from sensorgrid.sources.listing import page_links

LOOK_BACK_DAYS = 9


@dataclass
class Discovery:
    """``links``: new files of the chosen day; ``checked``: names to remember; ``accepted``: new sensors."""

    links: DataFrame
    checked: DataFrame
    accepted: DataFrame


def new_links(listings: DataFrame, checked: DataFrame, server: str = ARCHIVE_URL) -> DataFrame:
    """``day, href, url`` of unseen outdoor files, from ``day, html`` listings."""
    links = select.day_links(page_links(listings, keep=("day",)).drop("pos"), F.col("day"))
    fresh = joins.unseen_links(links, checked)
    return fresh.withColumn("url", F.concat(F.lit(server), F.col("day").cast("string"), F.lit("/"), "href"))


def latest_new_links(links: DataFrame, today, look_back: int = LOOK_BACK_DAYS) -> DataFrame:
    """Links of the last day before ``today`` that has any, at most ``look_back`` days ago."""
    recent = links.filter((F.col("day") < today) & (F.col("day") >= F.date_sub(today, look_back)))
    return recent.filter(F.col("day") == recent.agg(F.max("day")).scalar())


def first_rows(file_rows: DataFrame) -> DataFrame:
    """``file, lat, lon`` of the first row of every file in time order."""
    row = F.struct(F.col("timestamp"), F.col("lat"), F.col("lon"))
    return file_rows.groupBy("file").agg(F.min(row).alias("_r")).select("file", "_r.lat", "_r.lon")


def discover(links: DataFrame, file_rows: DataFrame, box: Box = DISCOVERY_BOX) -> Discovery:
    """Check the position of every linked file that has arrived.

    A file whose first row has no readable position is neither remembered nor
    accepted, so it is tried again.
    """
    placed = select.with_position(
        links.join(first_rows(file_rows).withColumnRenamed("file", "href"), "href")
    )
    checked = placed.select(F.col("href").alias("name"))
    accepted = select.inside(placed, box).select(text.after_date("href").alias("sensor"))
    return Discovery(links, checked, accepted)
