"""Online model update per micro-batch.

State after batch ``i`` is one row in ``{path}/batch={i}``.  A batch reads the state of
the batch before it and overwrites its own, so a replay after a failure gives the
same state.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorgrid.config import Roles
from sensorgrid.model.trainer import SparseModel


def state_before(spark: SparkSession, path: str, batch_id: int, **options) -> SparseModel | None:
    """Model of the latest batch before ``batch_id``; the first state is batch -1."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as e:
        # A folder that is not there or is empty holds no state.
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    rows = table.filter(F.col("batch") < batch_id)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    return SparseModel.from_state(rows.filter(F.col("batch") == last).drop("batch"), **options)


def write_state(model: SparseModel, spark: SparkSession, path: str, batch_id: int) -> None:
    model.state(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def update_batch(path: str, roles: Roles = Roles(), **options):
    """``foreachBatch`` function that adds each micro-batch to the model."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        model = state_before(spark, path, batch_id, roles=roles, **options)
        if model is None:
            raise ValueError("build a model and write its state as batch -1 first")
        # The batch is read twice: for the new inducing points and for the sums.
        batch.persist()
        try:
            model.update(batch)
        finally:
            batch.unpersist()
        write_state(model, spark, path, batch_id)

    return run


def update_available(stream: DataFrame, path: str, checkpoint: str, roles: Roles = Roles(), **options) -> StreamingQuery:
    """Add all rows that have arrived, batch by batch, then stop."""
    return (
        stream.writeStream.foreachBatch(update_batch(path, roles, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
