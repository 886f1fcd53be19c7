"""Percentiles over the stations of an hour, and outages told from runs of zeros.

A percentile summary is a table of counts by value.  Summaries of parts merge by adding counts.  While a key has at
most ``exact`` different values they are kept as they are and percentiles are exact; beyond that values move to cells of
geometrically growing width, and every percentile is within a relative error of ``alpha``.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorgrid.functions import geo

# --- fixed values: the published table's centre, radius and percentiles --------
CENTRE_LAT, CENTRE_LON, RADIUS_M = 55.75, 37.62, 20_000.0
PERCENTS = (10, 25, 50, 75, 90)
# -----------------------------------------------------------------------------
EXACT = 10_000
ALPHA = 0.001


def within_radius(stations: DataFrame, lat: float = CENTRE_LAT, lon: float = CENTRE_LON, radius_m: float = RADIUS_M) -> DataFrame:
    """Stations at most ``radius_m`` true metres from a place."""
    return stations.filter(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)) <= radius_m)


# --- outages ----------------------------------------------------------------------------
def _beside_zeros(hourly: DataFrame, key: str, value: str, hour: str) -> DataFrame:
    """Each row with the nearest values other than 0 before and after it, empty hours skipped.

    Both windows run from an end of the sensor's hours, so each row is added once.
    """
    other = F.when(F.col(value) != 0, F.struct(F.col(hour).alias("hour"), F.col(value).alias("value")))
    back = Window.partitionBy(key).orderBy(hour).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy(F.desc(hour)).rowsBetween(Window.unboundedPreceding, -1)
    return hourly.withColumns({"_before": F.last(other, ignorenulls=True).over(back), "_after": F.last(other, ignorenulls=True).over(ahead)})


def _outage(value: Column, high: float) -> Column:
    inside = (F.col("_before.value") >= high) & (F.col("_after.value") >= high)
    return F.coalesce((value == 0) & inside, F.lit(False))


def flag_outages(hourly: DataFrame, key: str, value: str, high: float, hour: str = "hour") -> DataFrame:
    """The hourly rows with ``outage``: a 0 in a run of zeros whose neighbours on both sides are ``high`` or more.

    Not every 0 is an outage: a run at either end of the series, or beside a low value, is not.
    """
    return _beside_zeros(hourly, key, value, hour).withColumn("outage", _outage(F.col(value), high)).drop("_before", "_after")


def zero_runs(hourly: DataFrame, key: str, value: str, high: float, hour: str = "hour") -> DataFrame:
    """``key, start, end, hours, before, after, outage`` of each run of zeros; empty hours do not end a run."""
    zeros = _beside_zeros(hourly, key, value, hour).filter(F.col(value) == 0)
    # The hour of the value before names a run; the run before any value has none.
    return zeros.groupBy(key, "_before", "_after").agg(
        F.min(hour).alias("start"), F.max(hour).alias("end"), F.count(F.lit(1)).alias("hours")
    ).select(key, "start", "end", "hours", F.col("_before.value").alias("before"), F.col("_after.value").alias("after"),
             _outage(F.lit(0.0), high).alias("outage"))


# --- percentiles -------------------------------------------------------------------------
def _cell(value: Column, alpha: float) -> Column:
    """The middle of the geometric cell of a value, within a relative error of ``alpha``; 0 and values beyond doubles stay."""
    gamma = (1 + alpha) / (1 - alpha)
    index = F.ceil(F.log(F.abs(value)) / F.lit(log(gamma)))
    middle = F.exp(index.cast("double") * F.lit(log(gamma))) * F.lit(2 / (gamma + 1))
    return F.when((value == 0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(F.signum(value) * middle)


def bounded(summary: DataFrame, keys: Sequence[str], exact: int, alpha: float) -> DataFrame:
    """A summary whose keys with more than ``exact`` different values have cells instead."""
    crowded = summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") > exact).drop("_values")
    many = summary.join(crowded.withColumn("_many", F.lit(True)), list(keys), "left")
    value = F.when(F.col("_many"), _cell(F.col("value"), alpha)).otherwise(F.col("value"))
    return many.select(*keys, value.alias("value"), "n").groupBy(*keys, "value").agg(F.sum("n").alias("n"))


def percentile_summary(df: DataFrame, keys: Sequence[str], value: str, exact: int = EXACT, alpha: float = ALPHA) -> DataFrame:
    """``keys, value, n``: counts by value of each key; nulls are left out."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return bounded(counted, keys, exact, alpha)


def merged_summaries(parts: Sequence[DataFrame], keys: Sequence[str], exact: int = EXACT, alpha: float = ALPHA) -> DataFrame:
    """One summary of several; cells of the same ``alpha`` fall together."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return bounded(rows.groupBy(*keys, "value").agg(F.sum("n").alias("n")), keys, exact, alpha)


def percentiles(summary: DataFrame, keys: Sequence[str], percents: Sequence[int] = PERCENTS) -> DataFrame:
    """``keys, count, p10, p25, ...``, between two values interpolated as by ``percentile``.

    Ranks are running sums of counts within a key, and only the two values around each rank are looked up.
    """
    ordered = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = summary.withColumns({"_upto": F.sum("n").over(ordered), "_all": F.sum("n").over(Window.partitionBy(*keys))})

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("value")))

    place = {p: (F.col("_all") - 1) * F.lit(p) / F.lit(100.0) for p in percents}
    found = ranked.groupBy(*keys).agg(
        F.max("_all").alias("count"), *[at(F.floor(place[p])).alias(f"_lo{p}") for p in percents],
        *[at(F.ceil(place[p])).alias(f"_hi{p}") for p in percents])
    part = {p: (F.col("count") - 1) * F.lit(p) / F.lit(100.0) for p in percents}
    return found.select(*keys, "count", *[
        (F.col(f"_lo{p}") + (part[p] - F.floor(part[p])) * (F.col(f"_hi{p}") - F.col(f"_lo{p}"))).alias(f"p{p}") for p in percents])


def station_percentiles(hourly: DataFrame, stations: DataFrame, key: str, value: str, high: float, hour: str = "hour",
                        percents: Sequence[int] = PERCENTS, exact: int = EXACT, alpha: float = ALPHA,
                        centre: tuple[float, float] = (CENTRE_LAT, CENTRE_LON), radius_m: float = RADIUS_M) -> DataFrame:
    """``hour, outages, count, p10, ...`` over the stations within the radius; hours of outages do not count."""
    near = within_radius(stations, *centre, radius_m).select(key).distinct()
    flagged = flag_outages(hourly.join(near, key, "left_semi"), key, value, high, hour)
    outages = flagged.groupBy(hour).agg(F.count(F.when(F.col("outage"), 1)).alias("outages"))
    summary = percentile_summary(flagged.filter(~F.col("outage")), [hour], value, exact, alpha)
    return outages.join(percentiles(summary, [hour], percents), hour)
