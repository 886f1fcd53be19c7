"""Outages, percentile summaries, counts of rejected rows, and streams whose state is kept by sensor."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorgrid.operators import stations
from sensorgrid.operators.counts import RunCounts, unreadable_readings
from sensorgrid.session import run_dir
from sensorgrid.streaming import hourly, ingest, progress, upsert

T0 = dt.datetime(2024, 1, 1)


def hours(spark, series):
    rows = [(s, T0 + dt.timedelta(hours=h), v) for s, values in series.items() for h, v in enumerate(values) if v != "gap"]
    return spark.createDataFrame(rows, "station string, hour timestamp, pm double")


def test_zeros_between_high_values_are_outages(spark):
    df = hours(spark, {"a": [0.0, 30.0, 0.0, 0.0, 40.0, 0.0, 1.0, 0.0, None, 0.0, 50.0, 0.0], "b": [0.0, 0.0], "c": [30.0, 0.0, "gap", "gap", 0.0, 30.0]})
    flagged = {(r.station, (r.hour - T0).seconds // 3600) for r in stations.flag_outages(df, "station", "pm", 20.0).collect() if r.outage}
    assert flagged == {("a", 2), ("a", 3), ("c", 1), ("c", 4)}
    runs = sorted((r.station, (r.start - T0).seconds // 3600, (r.end - T0).seconds // 3600, r.hours, r.before or -1, r.after or -1, r.outage)
                  for r in stations.zero_runs(df, "station", "pm", 20.0).collect())
    assert runs == [("a", 0, 0, 1, -1, 30, False), ("a", 2, 3, 2, 30, 40, True), ("a", 5, 5, 1, 40, 1, False), ("a", 7, 9, 2, 1, 50, False),
                    ("a", 11, 11, 1, 50, -1, False), ("b", 0, 1, 2, -1, -1, False), ("c", 1, 4, 2, 30, 30, True)]


def test_percentiles_exact_and_within_the_bound(spark):
    rng = np.random.default_rng(1)
    values = {"few": rng.normal(50, 20, 37).round(1), "many": np.concatenate([rng.lognormal(3, 2, 4000), -rng.lognormal(1, 1, 500), np.zeros(40)]), "one": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double")

    def check(summary, alpha):
        for r in stations.percentiles(summary, ["k"]).collect():
            vs = values[r.k]
            assert r["count"] == len(vs)
            for p in stations.PERCENTS:
                want = np.percentile(vs, p)
                assert abs(r[f"p{p}"] - want) <= (1e-12 if r.k != "many" or not alpha else alpha) * max(abs(want), 1e-9) + (0 if alpha else 1e-9)

    check(stations.percentile_summary(df, ["k"], "v"), 0)
    small = stations.percentile_summary(df, ["k"], "v", exact=1000, alpha=0.01)
    check(small, 0.0101)
    assert small.filter("k = 'many'").count() < 1500
    # Parts merge to the summary of the whole.
    parts = [stations.percentile_summary(df.filter(F.pmod(F.hash("v"), F.lit(3)) == k), ["k"], "v", exact=1000, alpha=0.01) for k in range(3)]
    check(stations.merged_summaries(parts, ["k"], exact=1000, alpha=0.01), 0.0101)


def test_counts_come_with_the_rows(spark):
    rows = [("1", 1.0, 2.0, T0), (None, None, 2.0, T0), ("3", 1.0, None, None), ("4", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "sensor_id string, lat double, lon double, timestamp timestamp")
    path = run_dir(spark, "counted")
    df.write.parquet(f"{path}/in")
    seen = RunCounts("r1")
    kept = seen.watch(spark.read.parquet(f"{path}/in"), "read", **unreadable_readings()).filter("lat IS NOT NULL AND lon IS NOT NULL")
    kept = seen.watch(kept, "kept")
    assert kept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    kept.write.parquet(f"{path}/out")
    assert seen.values() == {("read", "rows"): 4, ("read", "no_position"): 2, ("read", "no_time"): 2, ("read", "no_sensor"): 1, ("kept", "rows"): 2}
    assert {tuple(r) for r in seen.table(spark).collect()} == {("r1", s, c, n) for (s, c), n in seen.values().items()}
    with pytest.raises(ValueError):
        seen.watch(kept, "read")


def test_counts_of_a_stream_by_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "sensor_id bigint, lat double"
    for k, rows in enumerate([[(1, 1.0), (2, None)], [(3, None), (4, None), (5, 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        ingest.append_counted(stream, out, str(tmp_path / "cp"), str(tmp_path / "counts"), no_position=F.col("lat").isNull()).awaitTermination()
    got = {(r.batch, r.counter): r.n for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert got == {(0, "rows"): 2, (0, "no_position"): 1, (1, "rows"): 3, (1, "no_position"): 2}
    assert spark.read.parquet(out).count() == 5


def at(h):
    return T0 + dt.timedelta(hours=h)


def readings_in_files(spark, src, files):
    """One file for each list of ``(sensor, hour of day)``, in this order."""
    for rows in files:
        spark.createDataFrame([(s, at(h), float(h)) for s, h in rows], "sensor string, timestamp timestamp, v double").coalesce(1).write.mode("append").parquet(src)


def stream_of(spark, src):
    return spark.readStream.schema("sensor string, timestamp timestamp, v double").option("maxFilesPerTrigger", "1").parquet(src)


def undo_last_batch(checkpoint):
    """As after a crash between the last batch's output and its commit."""
    commits = sorted((int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()))
    os.remove(f"{checkpoint}/commits/{commits[-1]}")
    crc = f"{checkpoint}/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)


def test_silent_sensors_over_files_and_a_replay(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    readings_in_files(spark, src, [
        [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 30)], [("a", 2), ("a", 20), (None, 21)], [("a", 60), ("b", 61)], [("a", 61), ("a", 100), ("a", 101)]])

    def run():
        with progress.timer_state(spark):
            told = progress.progress_stream(stream_of(spark, src), "sensor", silence_hours=24)
            ingest.append_available(told, out, cp).awaitTermination()

    def state():
        table = spark.read.parquet(out)
        latest = {r.sensor: (r.n, r.first, r.last) for r in progress.latest_progress(table, "sensor").collect()}
        return latest, {(r.sensor, r.last, r.until) for r in progress.silences(table, "sensor").collect()}

    run()
    want = ({"a": (8, at(0), at(101)), "b": (2, at(0), at(61)), "c": (2, at(0), at(30))},
            {("a", at(20), at(60)), ("a", at(61), at(100)), ("b", at(0), at(61)), ("b", at(61), None), ("c", at(0), at(30)), ("c", at(30), None)})
    assert state() == want
    # The timers, not only later data, report: sensor c is silent to the end.
    undo_last_batch(cp)
    run()
    assert state() == want


def test_late_rows_correct_written_hours(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    files = [[("a", 0.1), ("a", 1.2), ("b", 0.5)], [("a", 1.4), ("a", 0.6), ("b", 2.4)], [("a", 0.9), ("b", 23.5), ("a", 3.0)], [("b", 25.0)], [("a", 3.5), ("a", 0.2)]]
    readings_in_files(spark, src, files)

    def run():
        hourly_rows = hourly.hourly_mean_stream(stream_of(spark, src), ["sensor"], ["v"])
        upsert.upsert_available(hourly_rows, out, cp).awaitTermination()
        return hourly_rows.schema

    schema = run()
    # The last file's rows are behind the watermark of the batch before; they are late for good.
    kept = [r for f in files[:4] for r in f]
    want = {}
    for s, h in kept:
        want.setdefault((s, at(int(h))), []).append(h)
    want = {k: pytest.approx(sum(v) / len(v)) for k, v in want.items()}

    def now():
        return {(r.sensor, r.hour): r.v for r in upsert.current_hours(upsert.versions(spark, out, schema), ["sensor"]).collect()}

    assert now() == want
    undo_last_batch(cp)
    run()
    assert now() == want
    newest = upsert.versions(spark, out, schema).agg(F.max("batch")).first()[0]
    assert upsert.compact_days(spark, out, schema, ["sensor"], newest) > 0
    assert now() == want and upsert.compact_days(spark, out, schema, ["sensor"], newest) == 0


def test_redelivered_rows_over_batches(spark, tmp_path):
    """A second delivery counts within the delay, and state goes when the watermark has passed."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    readings_in_files(spark, src, [[("a", 0), ("a", 1)], [("a", 1), ("b", 1), ("a", 2)], [("a", 9)], [("a", 10)], [("a", 2)], [("a", 10)]])
    once = ingest.drop_redelivered(stream_of(spark, src), ["sensor", "timestamp"])
    query = ingest.append_available(once, out, cp)
    query.awaitTermination()
    got = sorted((r.sensor, r.timestamp) for r in spark.read.parquet(out).collect())
    assert got == [("a", at(0)), ("a", at(1)), ("a", at(2)), ("a", at(9)), ("a", at(10)), ("b", at(1))]
    steps = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert steps[-1]["numRowsTotal"] <= 2 and sum(s["numRowsRemoved"] for s in steps) >= 4


def test_pairs_over_batches_with_late_rows(spark, tmp_path):
    """Late rows within the delay reach their hour, later ones do not; dust without a partner comes out once its hour is final."""
    dust, meteo, out, cp = (str(tmp_path / n) for n in ("dust", "meteo", "out", "cp"))
    readings_in_files(spark, dust, [[("d", 0.2), ("e", 0.3)], [("d", 1.1), ("d", 0.4)], [("d", 9.0)], [("d", 10.0)], [("d", 0.5)], [("e", 20.0)]])
    readings_in_files(spark, meteo, [[("m", 0.1)], [("m", 1.5), ("m", 0.9)], [("m", 9.5)], [("m", 10.0)], [("m", 1.9)], [("m", 20.0)]])
    pairs = spark.createDataFrame([("d", "m"), ("e", "n")], "sds_sensor string, bme_sensor string")
    left = stream_of(spark, dust).withColumnsRenamed({"sensor": "sds_sensor", "v": "P1"})
    right = stream_of(spark, meteo).withColumnsRenamed({"sensor": "bme_sensor", "v": "pressure"})
    query = ingest.append_available(hourly.pair_streams(left, right, pairs, ["P1"], ["pressure"]), out, cp)
    query.awaitTermination()
    got = {(r.sds_sensor, r.hour): (round(r.P1, 6), None if r.pressure is None else round(r.pressure, 6)) for r in spark.read.parquet(out).collect()}
    assert got == {("d", at(0)): (0.3, 0.5), ("d", at(1)): (1.1, 1.5), ("e", at(0)): (0.3, None), ("d", at(9)): (9.0, 9.5), ("d", at(10)): (10.0, 10.0)}
