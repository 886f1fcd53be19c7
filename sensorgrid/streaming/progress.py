"""Progress of every sensor as state of a stream, and reports of silent ones.

The state of a sensor is its row count and its first and last reading.  A timer stands at the last reading plus the
allowed silence; when the watermark passes it the sensor is reported as silent, and the next reading closes that report.

Tasks fold their rows into runs of readings first, so a sensor with a third of all readings sends a
few rows to the task that holds its state.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sensorgrid.session import local_state_width

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "{key} {type}, kind string, n bigint, first_us bigint, last_us bigint, until_us bigint"


@contextmanager
def timer_state(spark: SparkSession):
    """Streams started inside keep their state where timers are possible, one partition per core at most."""
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKS)
    try:
        with local_state_width(spark):
            yield
    finally:
        spark.conf.set(STATE_PROVIDER, before)


def runs_of_readings(rows: DataFrame, key: str, time: str, silence_us: int) -> DataFrame:
    """``key, n, first_us, last_us, last``: readings of a batch without a pause over ``silence_us`` between them.

    Runs of several tasks may lie in each other; their union has the same pauses as the readings.
    """
    kind = rows.schema[key].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values(["key", "at"])
            starts = (pdf["key"] != pdf["key"].shift()) | (pdf["at"].diff() > silence_us)
            runs = pdf.groupby(starts.cumsum(), sort=False).agg(
                key=("key", "first"), n=("at", "size"), first_us=("at", "min"), last_us=("at", "max"))
            yield runs.rename(columns={"key": key})

    known = rows.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    folded = known.select(F.col(key).alias("key"), F.unix_micros(time).alias("at")).mapInPandas(
        fold, f"{key} {kind}, n bigint, first_us bigint, last_us bigint")
    return folded.withColumn("last", F.timestamp_micros("last_us"))


class SensorProgress(StatefulProcessor):
    """Adds runs of readings to a sensor's progress; reports pauses over ``silence_us``."""

    def __init__(self, key: str, silence_us: int):
        self.key, self.silence_us = key, silence_us

    def init(self, handle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "n bigint, first_us bigint, last_us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        runs = pd.concat(list(rows)).sort_values("first_us")
        n, first, last = self.progress.get() if self.progress.exists() else (0, None, None)
        before, out = last, []
        for count, start, end in zip(runs["n"], runs["first_us"], runs["last_us"]):
            if last is not None and start - last > self.silence_us:
                out.append(("silent", None, None, last, int(start)))
            n += int(count)
            first = int(start) if first is None else min(first, int(start))
            last = int(end) if last is None else max(last, int(end))
        self.progress.update((n, first, last))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))
        yield self._frame(key, [*out, ("progress", n, first, last, None)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(key, [("silent", None, None, self.progress.get()[2], None)])

    def close(self) -> None:
        pass

    def _due(self, last_us: int) -> int:
        return (last_us + self.silence_us) // 1000

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        pdf = pd.DataFrame(rows, columns=["kind", "n", "first_us", "last_us", "until_us"])
        for c in ("n", "first_us", "last_us", "until_us"):
            pdf[c] = pdf[c].astype("Int64")
        pdf.insert(0, self.key, key[0])
        return pdf


def progress_stream(stream: DataFrame, key: str = "sensor_id", time: str = "timestamp", silence_hours: int = 24, delay: str = "2 hours") -> DataFrame:
    """Append-mode rows ``key, kind, n, first_us, last_us, until_us``.

    ``progress`` rows hold a sensor's count, first and last reading after a batch.  ``silent`` rows hold the reading before a
    pause of more than ``silence_hours`` in ``last_us`` and the one after it in ``until_us``, null while the sensor is still silent.
    A reading that comes after a later one of its sensor counts, but does not cut a pause that was reported; rows behind the
    watermark are dropped.  Start the stream inside :func:`timer_state`.
    """
    silence_us = silence_hours * 3_600_000_000
    runs = runs_of_readings(stream, key, time, silence_us).withWatermark("last", delay)
    return runs.groupBy(key).transformWithStateInPandas(
        SensorProgress(key, silence_us), OUTPUT.format(key=key, type=stream.schema[key].dataType.simpleString()), "append", "eventTime")


def latest_progress(table: DataFrame, key: str = "sensor_id") -> DataFrame:
    """``key, n, first, last`` from the rows of the stream: the newest progress of each sensor."""
    rows = table.filter("kind = 'progress'").groupBy(key).agg(F.max(F.struct("n", "first_us", "last_us")).alias("p"))
    return rows.select(key, "p.n", F.timestamp_micros("p.first_us").alias("first"), F.timestamp_micros("p.last_us").alias("last"))


def silences(table: DataFrame, key: str = "sensor_id") -> DataFrame:
    """``key, last, until`` of every reported pause; ``until`` is null where it has not ended."""
    rows = table.filter("kind = 'silent'").groupBy(key, "last_us").agg(F.max("until_us").alias("until_us"))
    return rows.select(key, F.timestamp_micros("last_us").alias("last"), F.timestamp_micros("until_us").alias("until"))
