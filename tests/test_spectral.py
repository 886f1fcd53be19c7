import datetime as dt

import numpy as np
import pytest

from sensorgrid.operators import numbering, spectral


def _series(spark, y):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t bigint, y double")


def test_autocovariance_equals_definition(spark):
    y = np.random.default_rng(0).normal(size=300)
    d = y - y.mean()
    want = np.array([np.dot(d[: len(d) - k], d[k:]) / len(d) for k in range(len(d))])
    for block in (4096, 64, 7):
        got = spectral.autocovariance(_series(spark, y), block=block).orderBy("lag").toPandas()
        assert list(got["lag"]) == list(range(300))
        assert np.allclose(got["acov"], want, atol=1e-12)
    part = spectral.autocovariance(_series(spark, y), max_lag=10, block=7).orderBy("lag").toPandas()
    assert np.allclose(part["acov"], want[:11], atol=1e-12) and len(part) == 11
    assert want[0] == pytest.approx(y.var())


def test_periodogram_finds_sine(spark):
    n = 240
    t = np.arange(n)
    y = 3 * np.sin(2 * np.pi * 10 * t / n) + 5
    p = spectral.periodogram(_series(spark, y), max_index=None).orderBy("k").toPandas()
    assert len(p) == n // 2 + 1
    assert p.loc[p["power"].idxmax(), "k"] == 10
    spec = np.abs(np.fft.rfft(y - y.mean())) ** 2 / n
    spec[1:-1] *= 2
    assert np.allclose(p["power"], spec, atol=1e-9)


def test_number_rows_is_dense_over_buckets(spark):
    base = dt.datetime(2020, 1, 1)
    stamps = [base + dt.timedelta(hours=7 * i) for i in range(50)]
    df = spark.createDataFrame([(s, 1.0) for s in reversed(stamps)], "timestamp timestamp, y double")
    got = spectral.indexed_series(df, "y").orderBy("t").toPandas()
    assert list(got["t"]) == list(range(50))
    ids = spark.range(0, 1003).withColumnRenamed("id", "v")
    numbered = numbering.number_rows(ids, ["v"], numbering.quantile_bucket(ids, "v", 10), "rn").toPandas()
    assert (numbered["rn"] == numbered["v"] + 1).all()
    parts = numbering.chunks(spark.range(10), 6, ["id"], numbering.quantile_bucket(spark.range(10), "id", 4), "id")
    assert [len(r["items"]) for r in parts.orderBy("chunk").collect()] == [6, 4]


@pytest.mark.parametrize("n", [1, 2, 3, 16, 97, 1000, 1531])
def test_full_transforms_of_any_length(spark, n):
    """All lags and all frequencies of lengths that are prime, short or no power of two, in small pieces."""
    from sensorgrid.operators import fourier

    y = np.random.default_rng(n).normal(5, 3, n)
    d = y - y.mean()
    acov = spectral.autocovariance(_series(spark, y), block=16).orderBy("lag").toPandas()
    assert np.allclose(acov["acov"], np.correlate(d, d, "full")[n - 1:] / n, atol=1e-11) and list(acov["lag"]) == list(range(n))
    power = fourier.full_periodogram(_series(spark, d), n, 16).orderBy("k").toPandas()
    assert np.allclose(power["power"], np.abs(np.fft.rfft(d)) ** 2, atol=1e-8) and list(power["k"]) == list(range(n // 2 + 1))


def test_model_passes_stay_on_the_scan_when_it_is_wide(spark, tmp_path):
    """No exchange before the map over a table of many scan partitions; a small one is dealt over the cores."""
    from sensorgrid.session import spread_if_small

    spark.range(100_000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda: spread_if_small(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        assert "Exchange" not in plan()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
