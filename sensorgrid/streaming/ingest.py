"""Arriving files to tables.

The stream's checkpoint remembers which files are done; it replaces a search for
the last stored row.  Every file is appended as it is, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorgrid.config import STATION_ZONE
from sensorgrid.operators import counts
from sensorgrid.sources import forecast, readings


def reading_stream(spark: SparkSession, folder: str, schema: T.StructType, **options: str) -> DataFrame:
    """Coerced readings of the ``;`` files that arrive in ``folder``."""
    return readings.with_file_sensor(readings.coerce(readings.stream_raw(spark, folder, schema, **options)))


def append_available(stream: DataFrame, path: str, checkpoint: str, partition_by: str | None = None) -> StreamingQuery:
    """Append all that has arrived to a Parquet table, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.trigger(availableNow=True).start(path)


def drop_redelivered(stream: DataFrame, keys: list[str], time: str = "timestamp", delay: str = "2 hours") -> DataFrame:
    """Keep the first of rows with equal keys that arrive within the delay of each other."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def sensor_progress(table: DataFrame, key: str = "sensor_id", time: str = "timestamp") -> DataFrame:
    """Rows, first and last reading per sensor of an ingested table."""
    return table.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")
    )


def append_counted(stream: DataFrame, path: str, checkpoint: str, counts_path: str, **conditions: Column) -> StreamingQuery:
    """Append all that has arrived, batch by batch, with the counts of each batch as rows of a second table.

    Rows and counts come from one pass.  Both have a folder per batch, which a replay replaces.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        seen = counts.RunCounts(f"batch {batch_id}")
        seen.watch(batch, "arrived", **conditions).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        seen.table(batch.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def forecast_available(
    spark: SparkSession, folder: str, path: str, checkpoint: str, counts_path: str | None = None, **options: str
) -> StreamingQuery:
    """Append forecast rows of arriving page files (one page per file); a bad page gives no rows.

    The snapshot time is the file's modification time and the first column belongs
    to its local day.  With ``counts_path`` the pages read and the good ones of each batch are counted there.
    """
    pages = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .options(**options)
        .load(folder)
        .select(
            F.xxhash64("_metadata.file_path").alias("page_id"),
            F.col("_metadata.file_modification_time").alias("seen"),
            F.col("value").alias("html"),
        )
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        local_day = F.to_date(F.from_utc_timestamp("seen", STATION_ZONE))
        seen = counts.RunCounts(f"batch {batch_id}") if counts_path else None
        rows = forecast.tidy_forecast(batch, local_day, F.col("seen"), counts=seen)
        # One folder per batch, overwritten on replay, keeps the append exact.
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if seen:
            seen.table(batch.sparkSession).coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/batch={batch_id}")

    return (
        pages.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
