import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import resample


def _stamps(rng, n, days=6):
    base = pd.Timestamp("2021-03-01")
    return base + pd.to_timedelta(np.sort(rng.integers(0, days * 86400, n)), unit="s")


def test_hourly_mean_equals_pandas(spark):
    rng = np.random.default_rng(0)
    frames = []
    for sensor in range(4):
        ts = _stamps(rng, 60)
        v = np.where(rng.random(60) < 0.2, np.nan, rng.normal(size=60))
        frames.append(pd.DataFrame({"sensor": sensor, "ts": ts, "a": v, "b": rng.integers(0, 9, 60)}))
    pdf = pd.concat(frames, ignore_index=True)
    rows = [(int(r.sensor), r.ts.to_pydatetime(), None if np.isnan(r.a) else float(r.a), int(r.b)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "sensor bigint, ts timestamp, a double, b bigint")
    got = resample.hourly_mean(df, ["sensor"]).toPandas().sort_values(["sensor", "hour"]).reset_index(drop=True)
    want = pdf.set_index("ts").groupby("sensor")[["a", "b"]].resample("1h").mean().reset_index()
    assert list(got["hour"]) == list(want["ts"]) and list(got["sensor"]) == list(want["sensor"])
    assert np.allclose(got["a"], want["a"], equal_nan=True) and np.allclose(got["b"], want["b"], equal_nan=True)


def test_rows_without_time_are_left_out(spark):
    df = spark.createDataFrame([(1, None, 5.0), (1, dt.datetime(2021, 1, 1, 3, 7), 7.0)], "s bigint, ts timestamp, v double")
    assert [tuple(r) for r in resample.hourly_mean(df, ["s"], ["v"]).collect()] == [(1, dt.datetime(2021, 1, 1, 3), 7.0)]


@pytest.mark.parametrize("seed", range(3))
def test_backfill_equals_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    ts = _stamps(rng, 40).unique()
    ts = ts.append(pd.DatetimeIndex(["2021-03-03 05:00:00", "2021-03-03 05:30:00"])).unique().sort_values()
    v = np.where(rng.random(len(ts)) < 0.3, np.nan, rng.normal(size=len(ts)))
    text = [f"w{i}" for i in range(len(ts))]
    want = pd.DataFrame({"v": v, "text": text}, index=ts).resample("1h").bfill()
    # Back-fill takes the whole next row, so a missing value inside it stays missing.
    index = ts.searchsorted(want.index)
    rows = [(t.to_pydatetime(), None if np.isnan(x) else float(x), s) for t, x, s in zip(ts, v, text)]
    df = spark.createDataFrame(rows, "ts timestamp, v double, text string").repartition(5)
    got = resample.backfill_hours(df, ["v", "text"]).orderBy("hour").toPandas()
    assert list(got["hour"]) == list(want.index)
    assert list(got["text"]) == [text[i] for i in index] == list(want["text"])
    assert np.allclose(got["v"], v[index], equal_nan=True)


def test_backfill_by_key_and_repeated_stamps(spark):
    t = lambda h, m=0: dt.datetime(2021, 1, 1, h, m)
    df = spark.createDataFrame(
        [("a", t(1, 30), 1.0), ("a", t(4), 2.0), ("b", t(2), 3.0), ("b", t(2), 4.0)], "k string, ts timestamp, v double"
    )
    got = resample.backfill_hours(df, ["v"], ["k"]).orderBy("k", "hour").collect()
    assert [tuple(r) for r in got] == [
        ("a", t(1), 1.0), ("a", t(2), 2.0), ("a", t(3), 2.0), ("a", t(4), 2.0), ("b", t(2), 3.0),
    ]
    assert [(r["k"], r["n"]) for r in resample.repeated_stamps(df, ["k"]).collect()] == [("b", 2)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    df = spark.range(100000).select(
        F.lit(1).alias("s"), (F.lit("2021-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"), F.col("id").alias("v")
    )
    plan = resample.hourly_mean(df, ["s"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_avg") > plan.index("Exchange hashpartitioning")  # below the exchange
    assert resample.hourly_mean(df, ["s"], ["v"]).count() == 28
