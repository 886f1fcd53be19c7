"""Time-fold and sensor-fold evaluation, map prediction.

A fold's model depends on the model before it, but only through M x M matrices.  The
inducing points of all folds follow from seeded draws, so the statistics of many
folds are summed in one pass over the data; the driver then chains the small
solves, and one more pass predicts.  Folds are taken in spans that keep the
matrices on the driver within a fixed budget; each span's predictions are
written before the next one starts, so the plan does not grow with the folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.config import Roles, StudyPeriod
from sensorgrid.model.posterior import Posterior, refreshed_points
from sensorgrid.model.statistics import X_COLUMNS, sufficient_statistics
from sensorgrid.model.trainer import SparseModel, TargetScale, best_update, predict_rows
from sensorgrid.operators import aggregates, folds, joins, sampling, select
from sensorgrid.session import run_dir
from sensorgrid.sources.tables import write_predictions

MATRIX_BUDGET = 64 << 20


@dataclass
class Evaluation:
    """Predictions (with ``fold``), errors per fold and their summary."""

    predictions: DataFrame
    errors: DataFrame
    summary: DataFrame
    model: SparseModel


def prepare(df: DataFrame, period: StudyPeriod, roles: Roles = Roles()) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of the study: known targets, floored at 1."""
    rows = select.study_period(select.check_roles(df, roles), period, roles.time)
    rows = select.floor_target(select.with_target(rows, roles.target), roles.target)
    return select.split_at(rows.select(*roles.required, roles.target), period.split, roles.time)


def _start(train: DataFrame, val: DataFrame, m: int, leaky: bool, roles: Roles, options: dict) -> SparseModel:
    scale = TargetScale.fit(train.unionByName(val) if leaky else train, roles)
    return SparseModel(scale, roles=roles, **options).build(train, m)


def _new_points(rows: DataFrame, count: int, seed: int) -> dict[int, np.ndarray]:
    """Different places and times drawn per fold; ``count`` x folds short rows reach the driver."""
    places = rows.select("fold", *X_COLUMNS).na.drop().distinct()
    drawn = sampling.sampled_rows_by(places, "fold", count, X_COLUMNS, seed).toPandas()
    return {int(f): p[X_COLUMNS].to_numpy(float) for f, p in drawn.sort_values(["fold", *X_COLUMNS]).groupby("fold")}


def _spans(ids: Sequence[int], m: int) -> list[list[int]]:
    size = max(1, MATRIX_BUDGET // (3 * 8 * m * m))
    return [list(ids[i : i + size]) for i in range(0, len(ids), size)]


def _chain(
    spark: SparkSession,
    model: SparseModel,
    train_rows: DataFrame,
    test_rows: DataFrame,
    update_first: bool,
    out: str,
) -> None:
    """Walk the folds and write the predictions of every span."""
    ids = [r["fold"] for r in folds.fold_steps(test_rows).orderBy("fold").collect()]
    m = len(model.posterior.z)
    scaled = model.scale.apply(train_rows, model.roles)
    for span in _spans(ids, m):
        here = F.col("fold").between(span[0], span[-1])
        rows = scaled.filter(here)
        wanted = m - int(model.keep * m)
        # Without new points every fold that has training rows updates the points it finds.
        fresh = _new_points(rows, wanted, model.seed) if wanted else {
            r["fold"]: model.posterior.z[:0] for r in folds.fold_steps(rows).collect()}
        points: dict[int, np.ndarray] = {}
        z = model.posterior.z
        for k in span:
            if k in fresh:
                z = refreshed_points(z, fresh[k], model.seed + k, model.keep)
                points[k] = z
        stats = (
            sufficient_statistics(rows, points, [model.posterior.kernel], "fold") if points else {}
        )
        used: dict[int, Posterior] = {}
        for k in span:
            if not update_first:
                used[k] = model.posterior
            if k in points:
                model.posterior = best_update(model.posterior, points[k], stats[(k, 0)], model.noises)
                model.updates += 1
            if update_first:
                used[k] = model.posterior
        part = predict_rows(test_rows.filter(here), used, model.scale, "fold", model.roles, True)
        write_predictions(part, out, mode="append")


def _report(spark: SparkSession, path: str, model: SparseModel) -> Evaluation:
    predictions = spark.read.parquet(path).withColumn("fold", F.col("fold").cast("bigint"))
    errors = aggregates.fold_errors(predictions, "fold", model.roles.target)
    steps = folds.fold_steps(predictions)
    return Evaluation(predictions, errors.join(steps, "fold"), aggregates.error_summary(errors), model)


def time_evaluation(
    train: DataFrame, val: DataFrame, m: int = 200, step_hours: int = 24, leaky: bool = False,
    roles: Roles = Roles(), path: str | None = None, include_last: bool = False, **options,
) -> Evaluation:
    """Predict each fold with the model of the folds before it, then add the fold."""
    spark = train.sparkSession
    model = _start(train, val, m, leaky, roles, options)
    rows = folds.assign_folds(val, roles.time, step_hours, include_last)
    out = path or run_dir(spark, "time-folds")
    _chain(spark, model, rows, rows, update_first=False, out=out)
    return _report(spark, out, model)


def sensor_evaluation(
    train: DataFrame, val: DataFrame, m: int = 200, step_hours: int = 24, fraction: float = 0.25, leaky: bool = False,
    roles: Roles = Roles(), path: str | None = None, **options,
) -> Evaluation:
    """Hold out a sample of sensors per fold, update on the others, predict the sample.

    A fold with no more sensors than the sample is all test data and updates nothing.
    """
    spark = train.sparkSession
    model = _start(train, val, m, leaky, roles, options)
    rows = folds.assign_folds(val, roles.time, step_hours)
    n = aggregates.sample_size(val, fraction, roles.sensor).first()["n"]
    held = sampling.sampled_ids_by(rows, "fold", F.lit(n), roles.sensor, model.seed)
    key = ["fold", roles.sensor]
    out = path or run_dir(spark, "sensor-folds")
    _chain(
        spark, model,
        rows.join(held, key, "left_anti").select(rows.columns),
        rows.join(held, key, "left_semi").select(rows.columns),
        update_first=True, out=out,
    )
    return _report(spark, out, model)


def map_prediction(
    model: SparseModel, df: DataFrame, lon_step: float = 0.025, lat_step: float = 0.0125
) -> DataFrame:
    """Prediction on a regular grid over the sensors that report at the latest time."""
    r = model.roles
    extent = aggregates.at_latest(df, r.time).agg(
        F.max(r.time).alias(r.time),
        F.min(r.lon).alias("lon_min"), F.max(r.lon).alias("lon_max"),
        F.min(r.lat).alias("lat_min"), F.max(r.lat).alias("lat_max"),
    )
    return model.predict(joins.map_grid(extent, lon_step, lat_step, keep=[r.time]), reference_variance=True)


def map_hexagons(model: SparseModel, df: DataFrame) -> DataFrame:
    """Prediction and variance of the map's grid averaged over hexagons, as the map shows them."""
    r = model.roles
    return aggregates.hexagon_mean(map_prediction(model, df), ["pred", "var"], r.lon, r.lat)


def city_series(predictions: DataFrame, time: str = "timestamp", target: str = "P1") -> DataFrame:
    """Mean observed and predicted value and variance per timestamp."""
    return aggregates.city_mean(predictions, time, [target, "pred", "var"])
