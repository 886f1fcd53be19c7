"""Tables the library writes and reads back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorgrid.operators.aggregates import error_summary
from sensorgrid.operators.joins import one_per_key
from sensorgrid.session import folder_exists


def write_sensors(sensors: DataFrame, path: str) -> None:
    """Sensor dimension, one row per pair."""
    sensors.write.mode("overwrite").parquet(path)


def read_sensors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(dataset: DataFrame, path: str, time: str = "timestamp", mode: str = "overwrite") -> None:
    """Hourly dataset in one folder per day.

    Rows are rebalanced by day before writing: adaptive execution joins small days into
    one task and cuts a day with very many rows into several, so files have an even size.
    """
    (
        dataset.withColumn("date", F.to_date(time))
        .hint("rebalance", "date")
        .write.mode(mode)
        .partitionBy("date")
        .parquet(path)
    )


def read_dataset(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of ``[start, end)``; the bounds prune day folders and row groups."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(
            (F.col("date") >= F.lit(start).cast("date")) & (F.col("timestamp") >= F.lit(start).cast("timestamp"))
        )
    if end is not None:
        df = df.filter(
            (F.col("date") <= F.lit(end).cast("date")) & (F.col("timestamp") < F.lit(end).cast("timestamp"))
        )
    return df.drop("date")


def append_rows(df: DataFrame, path: str) -> None:
    """Append as is; loading the same rows twice stores them twice."""
    df.write.mode("append").parquet(path)


def append_new_rows(df: DataFrame, path: str, keys: Sequence[str] = ("sensor_id", "timestamp"), time: str = "timestamp") -> None:
    """Append one row of each key that the table does not hold; loading the same rows twice stores them once.

    ``time`` is one of the keys.  Of the stored rows only the times that the load spans are read, and only their keys.
    What is stored stays as it is.  Rows without a whole key cannot be told apart and are appended as they are.
    """
    fresh, spark = one_per_key(df, keys), df.sparkSession
    if folder_exists(spark, path):
        low, high = df.agg(F.min(time)).scalar(), df.agg(F.max(time)).scalar()
        stored = spark.read.schema(df.schema).parquet(path).filter(F.col(time).between(low, high))
        fresh = fresh.join(stored.select(*keys), list(keys), "left_anti").select(df.columns)
    fresh.write.mode("append").parquet(path)


def write_predictions(predictions: DataFrame, path: str, fold: str = "fold", mode: str = "overwrite") -> None:
    predictions.write.mode(mode).partitionBy(fold).parquet(path)


def write_metrics(folds: DataFrame, result_path: str, plot_path: str, step: str = "step") -> None:
    """``mean RMSE``/``RMSE std`` as one JSON row and ``step``/``RMSE`` rows."""
    error_summary(folds).select(
        F.col("mean_rmse").alias("mean RMSE"), F.col("rmse_std").alias("RMSE std")
    ).coalesce(1).write.mode("overwrite").json(result_path)
    folds.select(F.col(step).alias("step"), F.col("rmse").alias("RMSE")).write.mode("overwrite").json(plot_path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """Comma-separated with a header, as forecast snapshots are kept."""
    df.write.mode(mode).option("header", "true").csv(path)
