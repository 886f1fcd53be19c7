"""Feature, periodicity and evaluation studies over the hourly dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorgrid.config import Roles, StudyPeriod
from sensorgrid.functions import scalar
from sensorgrid.model import evaluate
from sensorgrid.operators import aggregates, select, spectral
from sensorgrid.session import stored


def feature_correlations(dataset: DataFrame, target: str = "P1") -> DataFrame:
    """Correlations of the log target with weather and spatial features: ``group, a, b, corr``.

    Both groups come from one scan.
    """
    weather = [c for c in aggregates.METEO_FEATURES if c in dataset.columns]
    space = [c for c in aggregates.SPACE_FEATURES if c in dataset.columns]
    every = aggregates.log_correlation(dataset, [*weather, *space], target)
    member = F.array(
        F.when(F.col("a").isin(*weather, target) & F.col("b").isin(*weather, target), F.lit("weather")),
        F.when(F.col("a").isin(*space, target) & F.col("b").isin(*space, target), F.lit("space")),
    )
    return every.withColumn("group", F.explode(F.array_compact(member))).select("group", "a", "b", "corr")


def feature_pairs(dataset: DataFrame, features: list[str], target: str = "P1") -> DataFrame:
    """Scatter data: every feature value with its log target, long form."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return dataset.select(F.explode(pairs).alias("_p"), F.ln(target).alias("y")).select("_p.feature", "_p.x", "y")


def periodicity(
    dataset: DataFrame, period: StudyPeriod, time: str = "timestamp", target: str = "P1", max_index: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Autocovariance of the scaled city series and the periodogram of it.

    City means are floored, put on the standardised log scale and indexed; the
    autocovariance over all lags is the input of the periodogram.  The dataset is
    read once: the city series (a row per timestamp) and the autocovariance are
    stored, since each of them is used several times.
    """
    city = aggregates.city_mean(select.study_period(dataset, period, time), time, [target])
    floored = stored(select.with_target(select.floor_target(city, target), target), "city")
    fit = aggregates.fit_target(floored, target, time).select(F.struct("mean", "sd").alias("f")).scalar()
    z = floored.select(time, scalar.standardise_log(target, fit["mean"], fit["sd"]).alias("z"))
    acov = stored(spectral.autocovariance(spectral.indexed_series(z, "z", time)), "autocovariance")
    as_series = acov.select(F.col("lag").alias("t"), F.col("acov").alias("y"))
    return acov, spectral.periodogram(as_series, max_index)


def time_folds(dataset: DataFrame, period: StudyPeriod, roles: Roles = Roles(), **options) -> evaluate.Evaluation:
    """Predict each day with the model of the days before it."""
    return evaluate.time_evaluation(*evaluate.prepare(dataset, period, roles), roles=roles, **options)


def sensor_folds(dataset: DataFrame, period: StudyPeriod, roles: Roles = Roles(), **options) -> evaluate.Evaluation:
    """Per day, predict held-out sensors from the others."""
    return evaluate.sensor_evaluation(*evaluate.prepare(dataset, period, roles), roles=roles, **options)
