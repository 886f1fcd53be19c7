"""Filters, projections and the role-based view of a readings frame.

Every function returns a new frame.  Comparisons are written against bare
columns, so they reach the Parquet scan as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import DUST_TYPE, METEO_TYPE, Box, Roles, StudyPeriod
from sensorgrid.functions import scalar, text
from sensorgrid.schemas import require_columns


# --- by type, place and time ----------------------------------------------------
def dust_sensors(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("sensor_type") == DUST_TYPE)


def meteo_sensors(positions: DataFrame) -> DataFrame:
    return positions.filter(F.col("sensor_type") == METEO_TYPE)


def inside(df: DataFrame, box: Box, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows inside the inclusive box."""
    return df.filter(scalar.in_box(lat, lon, box))


def with_position(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows whose latitude and longitude are numbers, as numbers."""
    return (
        df.withColumn(lat, scalar.to_number(lat))
        .withColumn(lon, scalar.to_number(lon))
        .filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    )


def _axis(col: str, key) -> Column | None:
    """A point, a half-open ``slice`` or ``None`` as a condition."""
    if key is None:
        return None
    if not isinstance(key, slice):
        return F.col(col) == key
    cond = None
    if key.start is not None:
        cond = F.col(col) >= key.start
    if key.stop is not None:
        upper = F.col(col) < key.stop
        cond = upper if cond is None else cond & upper
    return cond


def tloc(df: DataFrame, key, roles: Roles = Roles()) -> DataFrame:
    """Select by time: a value, or a slice that includes its start and not its stop."""
    if isinstance(key, str):
        key = F.lit(key).cast(df.schema[roles.time].dataType)
    elif isinstance(key, slice):
        kind = df.schema[roles.time].dataType
        cast = lambda v: F.lit(v).cast(kind) if v is not None else None
        key = slice(cast(key.start), cast(key.stop))
    cond = _axis(roles.time, key)
    return df if cond is None else df.filter(cond)


def sploc(df: DataFrame, lat=None, lon=None, roles: Roles = Roles()) -> DataFrame:
    """Select by place; each axis takes a value, a half-open slice or ``None``."""
    for col, key in ((roles.lat, lat), (roles.lon, lon)):
        cond = _axis(col, key)
        if cond is not None:
            df = df.filter(cond)
    return df


def study_period(df: DataFrame, period: StudyPeriod, time: str = "timestamp") -> DataFrame:
    return tloc(df, slice(period.start, period.end), Roles(time=time))


def split_at(df: DataFrame, split: str, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows before and rows from ``split`` on."""
    roles = Roles(time=time)
    return tloc(df, slice(None, split), roles), tloc(df, slice(split, None), roles)


# --- target -----------------------------------------------------------------------
def with_target(df: DataFrame, target: str = "P1") -> DataFrame:
    """Drop rows without a target value."""
    return df.na.drop(subset=[target])


def floor_target(df: DataFrame, target: str = "P1", floor: float = 1.0) -> DataFrame:
    return df.withColumn(target, scalar.floor_at(target, floor))


# --- roles ------------------------------------------------------------------------
def check_roles(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Raise ``AttributeError`` unless time, place and sensor columns are there."""
    require_columns(df, roles.required)
    return df


def select_x(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return check_roles(df, roles).select(*roles.x)


def select_y(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return check_roles(df, roles).select(roles.target)


def replace_x(df: DataFrame, roles: Roles = Roles(), **columns: Column) -> DataFrame:
    """A new frame whose feature columns are replaced by expressions."""
    require_columns(df, roles.x)
    unknown = set(columns) - set(roles.x)
    if unknown:
        raise AttributeError(f"no feature columns: {sorted(unknown)}")
    return df.withColumns(columns)


def replace_y(df: DataFrame, value: Column, roles: Roles = Roles()) -> DataFrame:
    return check_roles(df, roles).withColumn(roles.target, value)


def sensor_series(df: DataFrame, column: str, roles: Roles = Roles()) -> DataFrame:
    """One ordered (time, value) series per sensor, in long form.

    Range partitioning on (sensor, time) keeps every series in order across the
    output files and cuts a sensor with very many rows into several tasks.
    """
    check_roles(df, roles)
    return (
        df.select(roles.sensor, roles.time, column)
        .repartitionByRange(roles.sensor, roles.time)
        .sortWithinPartitions(roles.sensor, roles.time)
    )


# --- links ------------------------------------------------------------------------
def day_links(links: DataFrame, day: str | Column, href: str = "href") -> DataFrame:
    """Outdoor file links of a day, without the link to the parent folder.

    ``day`` is one ISO day, or the column that holds the day of each listing.
    """
    h = F.col(href)
    return links.filter(
        F.contains(h, day.cast("string") if isinstance(day, Column) else F.lit(day))
        & ~F.contains(h, F.lit(text.INDOOR_MARK))
        & (F.length(text.after_date(h)) > 0)
    )


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
