"""Hourly rows that later data may correct, kept in day folders by batch.

A stream in update mode sends a changed hour again.  Each batch writes its rows under ``day=.../batch=...`` and replaces
only those folders when it is replayed, so nothing is lost or doubled; the newest batch of a sensor and hour counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorgrid.session import remove_folder, stored


def write_versions(rows: DataFrame, path: str, batch_id: int, hour: str = "hour") -> None:
    """Write the rows of a batch; the same batch again replaces its own folders."""
    dated = rows.withColumns({"day": F.to_date(hour), "batch": F.lit(batch_id).cast("bigint")})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def upsert_available(hourly: DataFrame, path: str, checkpoint: str, hour: str = "hour") -> StreamingQuery:
    """Write every changed hour of an hourly aggregate until all that has arrived is done."""
    return (
        hourly.writeStream.foreachBatch(lambda batch, batch_id: write_versions(batch, path, batch_id, hour))
        .outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def versions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All versions, with ``day`` and ``batch``; filters on ``day`` prune folders."""
    whole = T.StructType([*schema.fields, T.StructField("day", T.DateType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(whole).parquet(path)


def current_hours(table: DataFrame, keys: Sequence[str], hour: str = "hour") -> DataFrame:
    """The newest version of each sensor and hour, with the number of its batch; hours of a day are met within its folder."""
    values = [c for c in table.columns if c not in (*keys, hour, "day", "batch")]
    newest = table.groupBy(*keys, hour, "day").agg(F.max(F.struct("batch", *values)).alias("_v"))
    return newest.select(*keys, hour, *[F.col("_v").getField(c).alias(c) for c in values], F.col("_v.batch").alias("batch"))


def compact_days(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], through: int, hour: str = "hour") -> int:
    """Fold the versions of batches up to ``through`` of each day into the day's newest such batch; the number of folders folded.

    ``through`` must be a finished batch of the stream, which is never replayed.  The folded rows are in place before
    older folders go, so a reader finds the same newest versions at any time, and a broken run is done again.
    """
    table = versions(spark, path, schema)
    folders = table.filter(F.col("batch") <= through).groupBy("day").agg(F.collect_set("batch").alias("batches")).filter(F.size("batches") > 1)
    old = [(r["day"], b) for r in folders.collect() for b in sorted(r["batches"])[:-1]]
    if not old:
        return 0
    days = sorted({day for day, _ in old})
    part = table.filter((F.col("batch") <= through) & F.col("day").isin(days))
    top = part.groupBy("day").agg(F.max("batch").alias("_top"))
    newest = current_hours(part, keys, hour).drop("batch").withColumn("day", F.to_date(hour))
    folded = stored(newest.join(F.broadcast(top), "day").withColumnRenamed("_top", "batch"), "folded-days")
    folded.select(*schema.names, "day", "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    for day, batch in old:
        remove_folder(spark, f"{path}/day={day}/batch={batch}")
    return len(old)
