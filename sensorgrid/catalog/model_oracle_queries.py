"""Model jobs with two fixed inducing points, whose posterior has a closed form that SQL can state.

With no jitter and all points kept, an online update equals the fit of all rows so far, so the oracle of every
sequential job is a running sum of the same few statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorgrid.catalog.base import place_sql, query, rounded
from sensorgrid.catalog.model_queries import PERIOD, study
from sensorgrid.catalog.scalar_queries import MATERN_SQL, PERIODIC_SQL
from sensorgrid.functions import kernels
from sensorgrid.model import evaluate, trainer
from sensorgrid.operators import select
from sensorgrid.plans import studies
from sensorgrid.session import local_state_width, run_dir
from sensorgrid.streaming import online

POINTS = ((200.0, 37.2, 55.6), (500.0, 37.9, 56.1))
NOISE, LENGTHS = 0.25, ((100.0, 0.5),)
CANDIDATES = ((100.0, 0.5), (60.0, 0.5), (100.0, 0.3))


def _kernel(lengths):
    time, space = lengths
    return kernels.time_cov(lengthscale=time, modulated_lengthscale=time) * kernels.space_cov(lengthscale=space)


OPTIONS = {"kernels": (_kernel(LENGTHS[0]),), "points": POINTS, "noises": (NOISE,), "amplitudes": (1.0,), "keep": 1.0, "jitter": 0.0}


def _covariance(t: str, lon: str, lat: str, point) -> str:
    dt, space = f"({t} - {point[0]}::DOUBLE)", f"sqrt(pow({lon} - {point[1]}::DOUBLE, 2) + pow({lat} - {point[2]}::DOUBLE, 2))"
    trend, cycles = MATERN_SQL.format(d=dt, l="lt"), " + ".join(PERIODIC_SQL.format(d=dt, p=p) for p in (8, 10, 30, 2))
    return f"amp * ({trend}) * (1 + {cycles}) * ({MATERN_SQL.format(d=space, l='ls')})"


def _models(fitted: str, step: str, settings=((*LENGTHS[0], 1.0, NOISE),), extra: str = "", learnt: str = "TRUE") -> str:
    """``g``: one model for each setting and step, from the rows of all steps up to it; ``k``: rows with their covariances.

    ``fitted`` picks the rows of the target's scale, ``step`` numbers the rows, ``learnt`` picks those that are added.
    """
    rows = ", ".join(f"({i}, {lt}::DOUBLE, {ls}::DOUBLE, {amp}::DOUBLE, {s}::DOUBLE)" for i, (lt, ls, amp, s) in enumerate(settings))
    sums = "sum({0}) OVER w AS {0}"
    names = ["n", "yy", "a00", "a01", "a11", "b0", "b1"]
    k01 = _covariance(f"{POINTS[0][0]}::DOUBLE", f"{POINTS[0][1]}::DOUBLE", f"{POINTS[0][2]}::DOUBLE", POINTS[1])
    return f"""
WITH s AS (SELECT h.sds_sensor, h.hour, {place_sql('sds_sensor // 2')}, CASE WHEN P1 <= 1 THEN 1.0 ELSE P1 END AS P1 FROM dust_h h),
f AS (SELECT avg(ln(P1)) AS mean, stddev_pop(ln(P1)) AS sd, min(hour) AS start FROM s WHERE {fitted}),
v(setting, lt, ls, amp, noise) AS (VALUES {rows}){extra},
x AS (SELECT s.*, ({step})::BIGINT AS step, mean, sd, date_diff('microsecond', start, hour) / 3.6e9 AS t, (ln(P1) - mean) / sd AS z FROM s, f),
k AS (SELECT x.*, v.*, {_covariance('t', 'lon', 'lat', POINTS[0])} AS k0, {_covariance('t', 'lon', 'lat', POINTS[1])} AS k1 FROM x, v),
a AS (SELECT setting, step, count(*) FILTER (WHERE {learnt}) AS n, {', '.join(
        f"coalesce(sum({e}) FILTER (WHERE {learnt}), 0) AS {c}" for c, e in zip(names[1:], ["z * z", "k0 * k0", "k0 * k1", "k1 * k1", "k0 * z", "k1 * z"]))}
    FROM k WHERE step IS NOT NULL GROUP BY 1, 2),
c AS (SELECT setting, step, {', '.join(sums.format(c) for c in names)} FROM a WINDOW w AS (PARTITION BY setting ORDER BY step)),
m AS (SELECT c.*, v.noise, 5 * amp AS kxx, {k01} AS k01 FROM c JOIN v ON v.setting = c.setting),
d AS (SELECT *, kxx + a00 / noise AS g00, k01 + a01 / noise AS g01, kxx + a11 / noise AS g11, kxx * kxx - k01 * k01 AS dk FROM m),
e AS (SELECT *, g00 * g11 - g01 * g01 AS dg FROM d),
w AS (SELECT *, (g11 * b0 - g01 * b1) / dg / noise AS w0, (g00 * b1 - g01 * b0) / dg / noise AS w1 FROM e),
g AS (SELECT *, -0.5 * (n * ln(2 * pi() * noise) + yy / noise + kxx * n / noise) - 0.5 * (ln(dg) - ln(dk)) + 0.5 * (b0 * w0 + b1 * w1) / noise
    + 0.5 * (kxx * a00 - 2 * k01 * a01 + kxx * a11) / dk / noise AS bound, lag(step) OVER (PARTITION BY setting ORDER BY step) AS before,
    lead(step) OVER (PARTITION BY setting ORDER BY step) AS after FROM w)"""


def _predicted(match: str, where: str = "TRUE") -> str:
    """``y``: rows of ``k`` with the prediction of the model that ``match`` picks for them."""
    return f""",
q AS (SELECT k.*, k0 * w0 + k1 * w1 AS mu, kxx - (kxx * k0 * k0 - 2 * k01 * k0 * k1 + kxx * k1 * k1) / dk
    + (g11 * k0 * k0 - 2 * g01 * k0 * k1 + g00 * k1 * k1) / dg AS var_latent FROM k JOIN g ON {match} WHERE {where}),
y AS (SELECT *, exp(mu * sd + mean) AS pred, exp((mu - 1.96 * sqrt(greatest(var_latent, 0))) * sd + mean) AS low,
    exp((mu + 1.96 * sqrt(greatest(var_latent, 0))) * sd + mean) AS high, exp(var_latent * sd + mean) AS var FROM q)"""


_ROW = "hour AS timestamp, round(lat, 6) AS lat, round(lon, 6) AS lon, sds_sensor, round(P1, 6) AS P1"
_VALUES = "round(pred, 3) AS pred, round(var_latent, 6) AS var_latent, round(low, 3) AS low, round(high, 3) AS high"


def _shown(df):
    wide = [c for c in ("pred", "low", "high", "var") if c in df.columns]
    return rounded(rounded(df, 3, *wide), 6, "lat", "lon", "P1", "var_latent")


@query(
    "m4_m6_two_point_fit",
    _models("TRUE", "0") + _predicted("TRUE") + f" SELECT {_ROW}, {_VALUES} FROM y",
    "dust_hourly",
)
def fit(spark, sf):
    df = study(spark, sf)
    return _shown(trainer.SparseModel(trainer.TargetScale.fit(df), **OPTIONS).build(df).predict(df))


_FIRST = f"hour < TIMESTAMP '{PERIOD.split}'"


@query(
    "m5_two_point_update",
    _models(_FIRST, "0") + _predicted("TRUE") + f" SELECT {_ROW}, {_VALUES} FROM y",
    "dust_hourly",
)
def update(spark, sf):
    """Build on the first part, update with the rest: the same as a fit of all rows."""
    df = study(spark, sf)
    first, rest = select.split_at(df, PERIOD.split)
    model = trainer.SparseModel(trainer.TargetScale.fit(first), **OPTIONS).build(first).update(rest)
    return _shown(model.predict(df))


_NOISES, _AMPLITUDES = (1.0, 0.25), (1.0, 0.5)


@query(
    "m7_two_point_evidence",
    _models("TRUE", "0", [(*ls, a, s) for ls in CANDIDATES for a in _AMPLITUDES for s in _NOISES])
    + " SELECT row_number() OVER (ORDER BY bound DESC) - 1 AS candidate, noise, round(bound, 3) AS bound FROM g",
    "dust_hourly",
)
def evidence(spark, sf):
    """Bounds of three kernels, each with two amplitudes and two noises, best first."""
    df = study(spark, sf)
    options = OPTIONS | {"kernels": tuple(map(_kernel, CANDIDATES)), "noises": _NOISES, "amplitudes": _AMPLITUDES}
    ranked = trainer.SparseModel(trainer.TargetScale.fit(df), **options).evidence(df)
    return rounded(ranked.select("candidate", "noise", "bound"), 3, "bound")


_IN = f"hour >= TIMESTAMP '{PERIOD.start}' AND hour < TIMESTAMP '{PERIOD.end}'"
_SPAN = f", o AS (SELECT min(hour) AS lo, max(hour) AS hi FROM s WHERE {_IN} AND NOT {_FIRST})"
_OFFSET = "date_diff('microsecond', (SELECT lo FROM o), hour)"
_FOLD = (f"CASE WHEN NOT ({_IN}) THEN NULL WHEN {_FIRST} THEN -1 WHEN floor({_OFFSET} / 86400000000) * 86400000000 "
         f"< (SELECT date_diff('microsecond', lo, hi) FROM o) THEN floor({_OFFSET} / 86400000000) END")
_FOLDS = _models(f"{_IN} AND {_FIRST}", _FOLD, extra=_SPAN) + _predicted("g.after = k.step")


def _time_folds(spark, sf):
    return studies.time_folds(study(spark, sf), PERIOD, **OPTIONS)


@query(
    "m8_p7_two_point_time_folds",
    _FOLDS + f" SELECT step AS fold, {_ROW}, {_VALUES}, round(var, 3) AS var FROM y",
    "dust_hourly",
)
def time_folds(spark, sf):
    """Each day predicted by the model of the days before it."""
    return _shown(_time_folds(spark, sf).predictions)


_ERRORS = """ SELECT fold, round(mse, 3) AS mse, round(sqrt(mse), 3) AS rmse, row_number() OVER (ORDER BY fold) - 1 AS step
FROM (SELECT step AS fold, avg(pow(P1 - pred, 2)) AS mse FROM y GROUP BY 1)"""


@query("m8_p7_two_point_time_errors", _FOLDS + _ERRORS, "dust_hourly")
def time_errors(spark, sf):
    return rounded(_time_folds(spark, sf).errors, 3)


_HELD = f""",
u AS (SELECT DISTINCT {_FOLD} AS fold, sds_sensor FROM s WHERE {_IN} AND NOT {_FIRST}),
r AS (SELECT fold, sds_sensor FROM u WHERE fold IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY fold ORDER BY md5(sds_sensor::VARCHAR || '#42'), sds_sensor)
    <= (SELECT round_even(count(DISTINCT sds_sensor) * 0.25::DOUBLE, 0) FROM s WHERE {_IN} AND NOT {_FIRST}))"""
_IS_HELD = "(step, sds_sensor) IN (SELECT (fold::BIGINT, sds_sensor) FROM r)"


@query(
    "m9_p8_two_point_sensor_errors",
    _models(f"{_IN} AND {_FIRST}", _FOLD, extra=_SPAN + _HELD, learnt="NOT held").replace(
        "AS k1 FROM x, v)", f"AS k1, {_IS_HELD} AS held FROM x, v)")
    + _predicted("g.step = k.step", "held") + _ERRORS,
    "dust_hourly",
)
def sensor_errors(spark, sf):
    """Per day, a quarter of the sensors predicted by a model that the others have updated."""
    return rounded(studies.sensor_folds(study(spark, sf), PERIOD, **OPTIONS).errors, 3)


@query(
    "m11_two_point_city_series",
    _FOLDS + " SELECT hour AS timestamp, round(avg(P1), 6) AS P1, round(avg(pred), 3) AS pred, round(avg(var), 3) AS var FROM y GROUP BY 1",
    "dust_hourly",
)
def city(spark, sf):
    """Observed and predicted city mean, each hour predicted by the model of the days before."""
    out = evaluate.city_series(_time_folds(spark, sf).predictions)
    return rounded(rounded(out, 3, "pred", "var"), 6, "P1")


#: The map of the latest hour in which sensors of several longitudes and latitudes report.
_MAP = f""",
shown AS (SELECT max(hour) AS hour FROM (SELECT hour FROM s GROUP BY hour HAVING count(DISTINCT lat) > 1 AND count(DISTINCT lon) > 1)),
span AS (SELECT hour, min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1 FROM s JOIN shown USING (hour) GROUP BY hour),
lons AS (SELECT *, lon0 + i * 0.025::DOUBLE AS lon FROM (SELECT *, unnest(generate_series(0, ceil((lon1 - lon0) / 0.025::DOUBLE)::BIGINT - 1)) AS i FROM span)),
grid AS (SELECT *, lat0 + j * 0.0125::DOUBLE AS lat FROM (SELECT *, unnest(generate_series(0, ceil((lat1 - lat0) / 0.0125::DOUBLE)::BIGINT - 1)) AS j FROM lons)),
places AS (SELECT grid.*, mean, sd, date_diff('microsecond', start, hour) / 3.6e9 AS t FROM grid, f),
cells AS (SELECT places.*, v.*, {_covariance('t', 'lon', 'lat', POINTS[0])} AS k0, {_covariance('t', 'lon', 'lat', POINTS[1])} AS k1 FROM places, v)"""
_MAP_ROWS = _models("TRUE", "0") + _MAP + _predicted("TRUE").replace("FROM k JOIN g", "FROM cells k JOIN g")


def _map_rows(spark, sf):
    """The fitted model and the rows up to the hour of the map."""
    df = study(spark, sf)
    several = df.groupBy("timestamp").agg(F.count_distinct("lat").alias("a"), F.count_distinct("lon").alias("b")).filter("a > 1 AND b > 1")
    hour = several.agg(F.max("timestamp")).first()[0]
    return trainer.SparseModel(trainer.TargetScale.fit(df), **OPTIONS).build(df), df.filter(F.col("timestamp") <= F.lit(hour))


@query(
    "m10_two_point_map",
    _MAP_ROWS + f" SELECT hour AS timestamp, round(lon, 6) AS lon, round(lat, 6) AS lat, {_VALUES}, round(var, 3) AS var FROM y",
    "dust_hourly",
)
def map_grid(spark, sf):
    """Prediction on the grid of the sensors of one hour."""
    return _shown(evaluate.map_prediction(*_map_rows(spark, sf)).withColumn("P1", F.lit(None).cast("double"))).drop("P1")


@query(
    "m10_a14_two_point_map_hexagons",
    _MAP_ROWS + """, b AS (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM y),
pads AS (SELECT *, CASE WHEN x1 > x0 THEN (x1 - x0) * 1e-9 ELSE abs(x0) * 0.1::DOUBLE END AS px, CASE WHEN y1 > y0 THEN (y1 - y0) * 1e-9 ELSE abs(y0) * 0.1::DOUBLE END AS py FROM b),
ext AS (SELECT x0 - px AS x0, x1 + px AS x1, y0 - py AS y0, y1 + py AS y1 FROM pads),
hexes AS (SELECT pred, var, (lon - x0) / ((x1 - x0) / 30) AS u, (lat - y0) / ((y1 - y0) / 17) AS v FROM y, ext),
near AS (SELECT *, pow(u - round_even(u, 0), 2) + 3 * pow(v - round_even(v, 0), 2) AS d1, pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS d2 FROM hexes)
SELECT CASE WHEN d1 < d2 THEN 0 ELSE 1 END::BIGINT AS lattice, (CASE WHEN d1 < d2 THEN round_even(u, 0) ELSE floor(u) END)::BIGINT AS ix,
(CASE WHEN d1 < d2 THEN round_even(v, 0) ELSE floor(v) END)::BIGINT AS iy, count(*) AS n, round(avg(pred), 3) AS pred, round(avg(var), 3) AS var
FROM near GROUP BY 1, 2, 3""",
    "dust_hourly",
)
def map_hexagons(spark, sf):
    """The predicted grid of one hour averaged over hexagons."""
    return rounded(evaluate.map_hexagons(*_map_rows(spark, sf)), 3)


_REST = f"(SELECT min(hour)::DATE AS lo, max(hour)::DATE - min(hour)::DATE + 1 AS days FROM s WHERE NOT {_FIRST})"


@query(
    "st6_two_point_online_model",
    _models(_FIRST, f"CASE WHEN {_FIRST} THEN -1 ELSE (hour::DATE - (SELECT lo FROM o)) * 4 // (SELECT days FROM o) END", extra=f", o AS {_REST}")
    + """ SELECT step AS batch, noise, 2 AS m, step + 1 AS updates,
    round(bound - coalesce(lag(bound) OVER (ORDER BY step), 0), 3) AS bound FROM g""",
    "dust_hourly",
)
def online_model(spark, sf):
    """Four spans of days update the model one after the other; a batch's bound is what it adds."""
    df = study(spark, sf)
    first, rest = select.split_at(df, PERIOD.split)
    root = run_dir(spark, "online")
    model = trainer.SparseModel(trainer.TargetScale.fit(first), **OPTIONS).build(first)
    online.write_state(model, spark, f"{root}/state", -1)
    day = F.to_date("timestamp")
    span = rest.agg(F.min(day).alias("first"), (F.datediff(F.max(day), F.min(day)) + 1).alias("days")).first()
    part = F.floor(F.datediff(day, F.lit(span["first"])) * 4 / F.lit(span["days"]))
    with local_state_width(spark):
        for k in range(4):
            rest.filter(part == k).write.mode("append").parquet(f"{root}/days")
            stream = spark.readStream.schema(df.schema).parquet(f"{root}/days")
            online.update_available(
                stream, f"{root}/state", f"{root}/checkpoint", noises=(NOISE,), keep=1.0, jitter=0.0).awaitTermination()
    return rounded(spark.read.parquet(f"{root}/state").select("batch", "noise", "bound", "m", "updates"), 3, "bound")
