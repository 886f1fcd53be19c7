"""Model jobs.  All but the summed statistics rest on matrix solves and have no oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import dust, place_lat, place_lon, place_sql, query, rounded
from sensorgrid.catalog.scalar_queries import MATERN_SQL, TIME_SQL
from sensorgrid.config import StudyPeriod
from sensorgrid.functions import kernels
from sensorgrid.model import evaluate, statistics, trainer
from sensorgrid.operators import aggregates, select
from sensorgrid.operators.resample import hourly_mean
from sensorgrid.operators.sampling import draw_key
from sensorgrid.plans import studies
from sensorgrid.session import stored

PERIOD = StudyPeriod("2024-01-01", "2024-02-01", "2024-01-11")
M = 200


def study(spark, sf):
    """Hourly dust of all sensors with their places, floored at 1, as a table."""
    hourly = hourly_mean(dust(spark, sf), ["sds_sensor"], ["P1"], fill=False)
    place = F.floor(F.col("sds_sensor") / 2).cast("bigint")
    return stored(select.floor_target(hourly).select(
        F.col("hour").alias("timestamp"), place_lat(place).alias("lat"), place_lon(place).alias("lon"), "sds_sensor", "P1"
    ), "dataset")


def _model(spark, sf):
    df = study(spark, sf)
    return trainer.SparseModel(trainer.TargetScale.fit(df)).build(df, M), df


A17_POINTS = 20
A17_SQL = f"""
WITH s AS (SELECT h.sds_sensor, h.hour, {place_sql('sds_sensor // 2')}, CASE WHEN P1 <= 1 THEN 1.0 ELSE P1 END AS P1 FROM dust_h h),
f AS (SELECT avg(ln(P1)) AS mean, stddev_pop(ln(P1)) AS sd, min(hour) AS start FROM s),
x AS (SELECT sds_sensor, hour, date_diff('microsecond', start, hour) / 3.6e9 AS t, lon, lat, (ln(P1) - mean) / sd AS z FROM s, f),
p AS (SELECT t AS zt, lon AS zlon, lat AS zlat, row_number() OVER
(ORDER BY md5(sds_sensor::VARCHAR || '#' || epoch_us(hour)::VARCHAR || '#42')) - 1 AS i FROM x QUALIFY i < {A17_POINTS}),
d AS (SELECT i, sds_sensor, hour, z, t - zt AS dt, sqrt(pow(lon - zlon, 2) + pow(lat - zlat, 2)) AS ds FROM x, p),
k AS (SELECT i, sds_sensor, hour, z, {TIME_SQL} * {MATERN_SQL.format(d='ds', l='0.05')} AS k FROM d)
SELECT a.i, b.i AS j, round(sum(a.k * b.k), 6) AS v FROM k a JOIN k b ON a.sds_sensor = b.sds_sensor AND a.hour = b.hour AND a.i <= b.i GROUP BY 1, 2
UNION ALL SELECT i, {A17_POINTS}, round(sum(k * z), 6) FROM k GROUP BY 1
UNION ALL SELECT -1, 0, round(sum(z * z), 6) FROM x UNION ALL SELECT -1, 1, count(*) FROM x
"""


@query("a17_sparse_statistics", A17_SQL, "dust_hourly")
def sparse_statistics(spark, sf):
    """Summed statistics of all hourly rows: upper triangle, kernel-weighted targets, scalars."""
    df = study(spark, sf)
    rows = trainer.TargetScale.fit(df).apply(df)
    drawn = rows.withColumn("us", F.unix_micros("timestamp")).orderBy(draw_key(["sds_sensor", "us"]))
    z = drawn.limit(A17_POINTS).select("t", "lon", "lat").toPandas().to_numpy(float)
    s = statistics.sufficient_statistics(rows, {0: z}, [kernels.get_kernel("basic")])[(0, 0)]
    n = len(z)
    cells = [(i, j, float(s.a[i, j])) for i in range(n) for j in range(i, n)]
    cells += [(i, A17_POINTS, float(s.b[i])) for i in range(n)] + [(-1, 0, s.yy), (-1, 1, s.n)]
    return rounded(spark.createDataFrame(cells, "i int, j int, v double"))


@query("m4_m6_build_and_predict")
def build_and_predict(spark, sf):
    model, df = _model(spark, sf)
    return rounded(model.predict(df))


@query("m5_online_update")
def online_update(spark, sf):
    """Build on the first part, update with the rest, predict all."""
    df = study(spark, sf)
    first, rest = select.split_at(df, PERIOD.split)
    model = trainer.SparseModel(trainer.TargetScale.fit(first)).build(first, M).update(rest)
    return rounded(model.predict(df))


@query("m7_candidate_evidence")
def evidence(spark, sf):
    """Bound of every setting of three kernels from one pass over the readings."""
    df = study(spark, sf)
    options = [
        kernels.time_cov(lengthscale=t) * kernels.space_cov(lengthscale=s)
        for t, s in [(5.0, 0.05), (12.0, 0.05), (5.0, 0.2)]
    ]
    model = trainer.SparseModel(trainer.TargetScale.fit(df), kernels=options)
    return rounded(model.evidence(df, M))


@query("m8_p7_time_fold_predictions")
def time_fold_predictions(spark, sf):
    return rounded(studies.time_folds(study(spark, sf), PERIOD, m=M).predictions)


@query("m8_p7_time_fold_errors")
def time_fold_errors(spark, sf):
    return rounded(studies.time_folds(study(spark, sf), PERIOD, m=M).errors)


@query("m9_p8_sensor_fold_errors")
def sensor_fold_errors(spark, sf):
    return rounded(studies.sensor_folds(study(spark, sf), PERIOD, m=M).errors)


@query("m10_map_prediction")
def map_prediction(spark, sf):
    """Grid over the sensors that report in the latest hour."""
    model, df = _model(spark, sf)
    return rounded(evaluate.map_prediction(model, df))


@query("m10_a14_map_hexagons")
def map_hexagons(spark, sf):
    """Predictions of all readings averaged over hexagons; ``evaluate.map_hexagons`` bins the predicted map itself."""
    model, df = _model(spark, sf)
    return rounded(aggregates.hexagon_mean(model.predict(df, reference_variance=True), ["pred", "var"]))


@query("m11_observed_and_predicted_series")
def city(spark, sf):
    """Observed and predicted city mean of the time folds: each fold predicted by the model of the days before."""
    return rounded(evaluate.city_series(studies.time_folds(study(spark, sf), PERIOD, m=M).predictions))
