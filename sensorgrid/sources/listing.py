"""Links of archive listing pages and of download responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.functions import text


def page_links(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per anchor: the kept columns, ``pos`` in the page and ``href``."""
    return pages.select(*keep, F.posexplode(text.hrefs(html)).alias("pos", "href"))


def download_links(responses: DataFrame, body: str = "body") -> DataFrame:
    """Archive URL named in each response text."""
    return responses.withColumn("link", text.archive_link(body))
