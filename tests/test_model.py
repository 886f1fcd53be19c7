import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.functions import kernels
from sensorgrid.model import evaluate, posterior, statistics, trainer

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def arrays():
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.uniform(0, 48, 200), 37.6 + rng.normal(0, 0.1, 200), 55.7 + rng.normal(0, 0.05, 200)])
    return x, rng.normal(size=200), x[rng.permutation(200)[:15]]


@pytest.fixture(scope="module")
def rows(spark, arrays):
    x, y, _ = arrays
    part = [0] * 120 + [1] * 80
    data = [(p, *map(float, r), float(v)) for p, r, v in zip(part, x, y)]
    return spark.createDataFrame(data, "part int, t double, lon double, lat double, z double")


def test_kernel_values_and_columns(spark):
    k = kernels.get_kernel("basic")
    x = np.random.default_rng(0).normal(size=(20, 3)) * [5, 0.05, 0.05]
    full = k.matrix(x, x)
    assert np.allclose(full, full.T) and np.allclose(np.diag(full), 5.0) and np.allclose(k.diagonal(x), 5.0)
    assert np.linalg.eigvalsh(full).min() > -1e-9
    assert kernels.kernel_from_json(k.to_json()) == k
    m = kernels.Matern32((0,), lengthscale=2.0).matrix(np.array([[0.0]]), np.array([[3.0]]))[0, 0]
    assert m == pytest.approx((1 + np.sqrt(3) * 1.5) * np.exp(-np.sqrt(3) * 1.5))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    col = k.column([F.col("a"), F.col("b"), F.col("c")], [F.lit(float(v)) for v in x[0]])
    assert np.allclose([r[0] for r in df.select(col).collect()], full[:, 0])
    with pytest.raises(KeyError):
        kernels.get_kernel("other")


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_statistics_do_not_depend_on_partitions(rows, arrays, parts):
    x, y, z = arrays
    k = kernels.get_kernel("basic")
    got = statistics.sufficient_statistics(rows.repartition(parts), {0: z}, [k, kernels.space_cov()])
    for c, kernel in enumerate([k, kernels.space_cov()]):
        kx = kernel.matrix(z, x)
        s = got[(0, c)]
        assert np.allclose(s.a, kx @ kx.T, atol=1e-10) and np.allclose(s.b, kx @ y, atol=1e-10)
        assert s.n == 200 and s.yy == pytest.approx(y @ y) and s.kd == pytest.approx(kernel.diagonal(x).sum())


def test_statistics_flush_when_many_groups(rows, arrays, monkeypatch):
    _, _, z = arrays
    monkeypatch.setattr(statistics, "HELD_BYTES", 1)
    many = rows.withColumn("g", (F.col("t") / 4).cast("int"))
    k = kernels.get_kernel("basic")
    by = statistics.sufficient_statistics(many, {g: z for g in range(13)}, [k], "g")
    whole = statistics.sufficient_statistics(rows, {0: z}, [k])[(0, 0)]
    assert np.allclose(sum(s.a for s in by.values()), whole.a, atol=1e-9)


def test_first_fit_is_the_exact_gp_when_every_row_is_inducing(arrays):
    x, y, _ = arrays
    x, y = x[:40], y[:40]
    k, noise = kernels.get_kernel("basic"), 0.3
    p = posterior.first_fit(k, noise, x, statistics.block_statistics(k, x, x, y))
    kxx = k.matrix(x, x) + noise * np.eye(40)
    assert np.allclose(p.mean_var(x)[0], k.matrix(x, x) @ np.linalg.solve(kxx, y), atol=1e-4)
    exact = -0.5 * y @ np.linalg.solve(kxx, y) - 0.5 * np.linalg.slogdet(kxx)[1] - 20 * np.log(2 * np.pi)
    assert p.bound == pytest.approx(exact, abs=1e-3)


def test_online_update_equals_batch_fit(rows, arrays):
    x, _, z = arrays
    k, noise = kernels.get_kernel("basic"), 1.0
    s = statistics.sufficient_statistics(rows, {0: z, 1: z}, [k], "part")
    first = posterior.first_fit(k, noise, z, s[(0, 0)])
    whole = posterior.first_fit(k, noise, z, s[(0, 0)] + s[(1, 0)])
    online = posterior.online_update(first, k, noise, z, s[(1, 0)])
    (m1, v1), (m2, v2) = whole.mean_var(x), online.mean_var(x)
    assert np.abs(m1 - m2).max() < 1e-4 and np.abs(v1 - v2).max() < 1e-5
    assert online.bound == pytest.approx(whole.bound - first.bound, abs=1e-2)


def test_scaled_statistics(arrays):
    x, y, z = arrays
    k = kernels.get_kernel("basic")
    a = statistics.block_statistics(kernels.scaled(k, 0.3), z, x, y)
    b = statistics.block_statistics(k, z, x, y).scaled(0.3)
    assert np.allclose(a.a, b.a) and np.allclose(a.b, b.b) and a.kd == pytest.approx(b.kd)


def test_refreshed_points_keep_their_number():
    z = np.arange(30.0).reshape(10, 3)
    new = -np.arange(30.0).reshape(10, 3) - 1
    out = posterior.refreshed_points(z, new, 1)
    assert len(out) == 10 and (out[:7] >= 0).all() and (out[7:] < 0).all()
    assert np.array_equal(out, posterior.refreshed_points(z, new, 1))


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(5)
    data = []
    for s in range(12):
        lon, lat = 37.5 + 0.02 * s, 55.7 + 0.01 * (s % 4)
        for h in range(24 * 6):
            v = np.exp(2 + np.sin(2 * np.pi * h / 24) + 0.1 * rng.normal())
            data.append((START + dt.timedelta(hours=h), lat, lon, s, float(v)))
    return spark.createDataFrame(data, "timestamp timestamp, lat double, lon double, sds_sensor bigint, P1 double").cache()


def test_model_learns_and_reports(spark, study):
    period = evaluate.StudyPeriod("2024-01-01", "2024-01-07", "2024-01-04")
    train, val = evaluate.prepare(study, period)
    res = evaluate.time_evaluation(train, val, m=30)
    errors = res.errors.orderBy("fold").toPandas()
    assert list(errors["step"]) == list(range(len(errors))) and len(errors) == 3
    pred = res.predictions.toPandas()
    spread = pred["P1"].std()
    assert len(pred) == val.count() and np.isfinite(errors["rmse"]).all()
    assert (pred["low"] <= pred["pred"]).all() and (pred["pred"] <= pred["high"]).all()
    held = evaluate.sensor_evaluation(train, val, m=30)
    hp = held.predictions.toPandas()
    assert hp.groupby("fold")["sds_sensor"].nunique().eq(3).all()
    assert held.summary.first()["mean_rmse"] < spread
    grid = evaluate.map_prediction(held.model, val).toPandas()
    assert len(grid) > 0 and np.isfinite(grid["pred"]).all() and grid["timestamp"].nunique() == 1
    assert evaluate.city_series(res.predictions).count() == pred["timestamp"].nunique()


def test_trainer_contract(spark, study):
    scale = trainer.TargetScale.fit(study)
    model = trainer.SparseModel(scale)
    with pytest.raises(ValueError):
        model.update(study)
    model.build(study, m=20).update(study.limit(100))
    back = trainer.SparseModel.from_state(model.state(spark))
    a = model.predict(study.limit(50)).toPandas()
    b = back.predict(study.limit(50)).toPandas()
    assert np.allclose(np.sort(a["pred"]), np.sort(b["pred"]))
    ranked = trainer.SparseModel(scale).evidence(study, 20).toPandas()
    assert ranked["bound"].is_monotonic_decreasing


def test_small_folds_are_all_test_data(spark, study):
    """With one sensor in a fold nothing is left to train on and the model stays."""
    period = evaluate.StudyPeriod("2024-01-01", "2024-01-07", "2024-01-04")
    train, val = evaluate.prepare(study, period)
    thin = val.filter((F.col("timestamp") < "2024-01-05") | (F.col("sds_sensor") == 3))
    res = evaluate.sensor_evaluation(train, thin, m=10)
    assert res.model.updates == 1
    assert set(res.predictions.filter("fold > 0").select("sds_sensor").distinct().toPandas()["sds_sensor"]) == {3}


def test_map_hexagons_cover_the_grid(study):
    model = trainer.SparseModel(trainer.TargetScale.fit(study)).build(study, 30)
    grid, cells = evaluate.map_prediction(model, study).toPandas(), evaluate.map_hexagons(model, study).toPandas()
    # Every place of the grid counts once, however many readings are near it.
    assert cells["n"].sum() == len(grid) > 0
    assert np.average(cells["pred"], weights=cells["n"]) == pytest.approx(grid["pred"].mean())


def test_city_query_averages_fold_predictions(spark, monkeypatch):
    from types import SimpleNamespace

    from sensorgrid.catalog import model_queries as queries

    made = spark.createDataFrame([(START, 1.0, 2.0, 3.0), (START, 3.0, 6.0, 5.0)], "timestamp timestamp, P1 double, pred double, var double")
    monkeypatch.setattr(queries, "study", lambda spark, sf: made)
    monkeypatch.setattr(queries.studies, "time_folds", lambda df, period, m: SimpleNamespace(predictions=made))
    row = queries.city(spark, "").first()
    assert (row["P1"], row["pred"], row["var"]) == (2.0, 4.0, 4.0)


def test_state_says_what_a_failed_factorisation_added():
    k, rng = kernels.get_kernel("basic"), np.random.default_rng(6)
    x, y = rng.random((30, 3)), rng.normal(size=30)
    sound, double = x[:5], np.vstack([x[:5], x[:5]])
    fit = lambda z: posterior.first_fits(k, [1.0], z, statistics.block_statistics(k, z, x, y), jitter=0.0)[0]
    bad = fit(double)
    assert bad.extra_jitter >= 1e-6 and bad.to_row()["jitter"] == 0.0
    assert posterior.Posterior.from_row(bad.to_row()).extra_jitter == bad.extra_jitter
    good = posterior.first_fit(k, 1.0, sound, statistics.block_statistics(k, sound, x, y))
    assert good.extra_jitter == 0.0
    after = posterior.online_update(bad, k, 1.0, sound, statistics.block_statistics(k, sound, x, y))
    assert after.extra_jitter >= bad.extra_jitter
