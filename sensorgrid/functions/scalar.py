"""Parsing, time and arithmetic column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorgrid.config import MMHG_TO_PA



def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_double() -> Column:
    return F.lit(None).cast("double")


def to_number(c) -> Column:
    """Double, or NULL for anything that is no number.

    NaN becomes NULL, because Spark's aggregates treat NaN as a value.  The JVM
    parser accepts a trailing ``d``/``f`` ("1.5f"); that is text here.
    """
    c = _col(c)
    suffixed = F.trim(c.cast("string")).rlike("[0-9.][dDfF]$")
    return F.when(~suffixed, F.nanvl(c.try_cast("double"), null_double()))


def nan_to_null(c) -> Column:
    return F.nanvl(_col(c), null_double())


def to_time(c, fmt: str | None = None) -> Column:
    """Timestamp, or NULL for anything that is no time."""
    c = _col(c)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.try_cast("timestamp")


def station_time(c) -> Column:
    """``dd.MM.yyyy HH:mm`` text as a (still local) timestamp."""
    return to_time(c, "dd.MM.yyyy HH:mm")


def station_day(c) -> Column:
    """Day part of ``dd.MM.yyyy HH:mm``."""
    return F.to_date(F.try_to_timestamp(F.split(_col(c), " ")[0], F.lit("dd.MM.yyyy")))


def to_utc(c, zone: str) -> Column:
    return F.to_utc_timestamp(_col(c), zone)


def hours_since(ts, start) -> Column:
    """Fractional hours from ``start`` to ``ts``."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(ts)) / F.lit(3.6e9)


def days_between(first, last) -> Column:
    """All days from ``first`` to ``last``, both included; empty when reversed."""
    first, last = _col(first), _col(last)
    return F.when(
        first <= last, F.sequence(first, last, F.expr("interval 1 day"))
    ).otherwise(F.array().cast("array<date>"))


def later_of(*dates) -> Column:
    """Latest of the given dates, NULLs skipped."""
    return F.greatest(*[_col(d) for d in dates])


def floor_at(c, floor: float = 1.0) -> Column:
    """Values at or under ``floor`` become ``floor``; NULL stays NULL."""
    c = _col(c)
    return F.when(c <= F.lit(floor), F.lit(floor)).otherwise(c)


def half_even(c, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def mmhg_to_pa(c) -> Column:
    return _col(c) * F.lit(MMHG_TO_PA)


def altitude_step(pressure, temperature, station_pressure) -> Column:
    """Height of the sensor over the station in metres, from the barometric step; NULL at zero pressure."""
    p, t, ps = _col(pressure), _col(temperature), _col(station_pressure)
    step = F.try_divide(F.lit(8000.0), p / 1000.0) * (F.lit(1.0) + F.lit(0.00366) * t)
    return -step * ((p - ps) / 1000.0)


def standardise_log(y, mean, sd) -> Column:
    return (F.ln(_col(y)) - _col(mean)) / _col(sd)


def unstandardise_log(z, mean, sd) -> Column:
    return F.exp(_col(z) * _col(sd) + _col(mean))


def unit_if_zero(sd) -> Column:
    """A zero spread scales by one."""
    sd = _col(sd)
    return F.when(sd == 0, F.lit(1.0)).otherwise(sd)


def in_box(lat, lon, box) -> Column:
    """Inclusive on all four sides."""
    return _col(lat).between(box.min_lat, box.max_lat) & _col(lon).between(box.min_lon, box.max_lon)


def surface_altitude(sealevel, ground) -> Column:
    """Height over the ground; NULL where either is unknown."""
    return _col(sealevel) - _col(ground)
