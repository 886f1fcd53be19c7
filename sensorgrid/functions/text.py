"""File names, links, URLs and page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorgrid.config import ARCHIVE_URL

# --- fixed values -----------------------------------------------------------
DATE_PREFIX = 10  # an ISO day leads every archive file name
INDOOR_MARK = "indoor"
HREF_PATTERN = r'(?i)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\']'
ARCHIVE_LINK_PATTERN = r"(https?://[^\s<>\"'#]+)"
# Labels of the forecast page rows, in the order in which they are tested.
FORECAST_LABELS = [
    ("time", "Местное время"),
    ("prec", "Осадки, мм"),
    ("temp", "Температура"),
    ("pressure", "Давление"),
    ("wind_speed", "Ветер"),
    ("wind_dir", "направление"),
    ("humidity", "Влажность"),
]
# -----------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def last_path_part(c) -> Column:
    return F.element_at(F.split(_col(c), "/"), -1)


def after_date(name) -> Column:
    """The part of an archive file name behind its leading day."""
    name = _col(name)
    return F.substr(name, F.lit(DATE_PREFIX + 1), F.greatest(F.length(name), F.lit(1)))


def stored_file_sensor(name) -> Column:
    """``(sensor_id, sensor_type)`` from ``{id}_{type}_sensor_.csv``."""
    parts = F.split(_col(name), "_")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("bigint").alias("sensor_id"),
        F.upper(F.get(parts, F.lit(1))).alias("sensor_type"),
    )


def archive_file_sensor(name) -> Column:
    """``(sensor_id, sensor_type)`` from ``{day}_{type}_sensor_{id}.csv`` or its suffix."""
    parts = F.split(F.split(_col(name), r"\.")[0], "_")
    return F.struct(
        F.get(parts, F.lit(3)).try_cast("bigint").alias("sensor_id"),
        F.get(parts, F.lit(1)).alias("sensor_type"),
    )


def stored_file_name(sensor_id, sensor_type) -> Column:
    return F.concat_ws("_", _col(sensor_id).cast("string"), _col(sensor_type), F.lit("sensor"), F.lit(".csv"))


def archive_url(sensor_id, day, sensor_type, server: str = ARCHIVE_URL) -> Column:
    """URL of one sensor's readings of one day."""
    day = _col(day).cast("string")
    name = F.concat_ws("_", day, _col(sensor_type), F.lit("sensor"), _col(sensor_id).cast("string"))
    return F.concat(F.lit(server), day, F.lit("/"), name, F.lit(".csv"))


def hrefs(html) -> Column:
    """Targets of all anchors of a page, in page order."""
    return F.regexp_extract_all(_col(html), F.lit(HREF_PATTERN), F.lit(1))


def archive_link(response) -> Column:
    """First URL in a script response, with ``..`` path parts taken out."""
    url = F.regexp_extract(_col(response), ARCHIVE_LINK_PATTERN, 1)
    return F.array_join(F.filter(F.split(url, "/"), lambda part: part != F.lit("..")), "/")


def first_token(c) -> Column:
    """First whitespace-separated token, NULL when there is none."""
    token = F.regexp_extract(_col(c), r"(\S+)", 1)
    return F.when(token != "", token)


def first_number(c) -> Column:
    return first_token(c).try_cast("double")


def row_role(label) -> Column:
    """Role of a forecast row; when several labels match, the last one wins."""
    label = _col(label)
    hits = F.filter(
        F.array(*[F.when(F.contains(label, F.lit(text)), F.lit(role)) for role, text in FORECAST_LABELS]),
        lambda r: r.isNotNull(),
    )
    return F.when(F.size(hits) > 0, F.element_at(hits, -1))
