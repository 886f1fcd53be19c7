"""Counts of what a run reads and rejects, taken in the same pass as its rows.

A frame is watched at the places that matter.  When the job that uses it has run, its counts are rows of a
table; nothing is read a second time for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

COUNTS = "run string, step string, counter string, n bigint"


class RunCounts:
    """The counters of one run.

    A watched frame has to be used by exactly one action, once in its plan; where a frame is read twice, store it first.
    """

    def __init__(self, run: str):
        self.run = run
        self.steps: dict[str, Observation] = {}

    def watch(self, df: DataFrame, step: str, **conditions: Column) -> DataFrame:
        """``df`` with counters ``rows`` and one for each condition; null conditions do not count."""
        if step in self.steps:
            raise ValueError(f"step {step} is watched already")
        self.steps[step] = Observation(f"{self.run}-{step}")
        return df.observe(self.steps[step], F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in conditions.items()])

    def values(self) -> dict[tuple[str, str], int]:
        """Counts by step and counter; waits for the action that uses the frames."""
        return {(step, name): int(n) for step, seen in self.steps.items() for name, n in seen.get.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``run, step, counter, n``."""
        return spark.createDataFrame([(self.run, step, name, n) for (step, name), n in self.values().items()], COUNTS)


def unreadable_readings() -> dict[str, Column]:
    """Conditions of coerced readings that later steps cannot use."""
    return {"no_position": F.col("lat").isNull() | F.col("lon").isNull(), "no_time": F.col("timestamp").isNull(),
            "no_sensor": F.col("sensor_id").isNull()}
