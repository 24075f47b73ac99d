"""Stage tables: read, write, resume, and batched writes that can restart."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.runtime import materialise, number_rows, path_exists
from topicloom.schemas import STAGES, conform

ROWS_PER_FILE = 50_000


class MissingStage(ValueError):
    """A stage table is not there yet; the message names the step that makes it."""


class StageStore:
    """Parquet tables of the stages under one folder.

    A stage counts as finished once its write has committed (``_SUCCESS``); ``stages`` maps a name to
    its schema and the step that builds it.
    """

    def __init__(self, spark: SparkSession, root: str, stages=STAGES):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), stages

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def finished(self, name: str) -> bool:
        return path_exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def read(self, name: str) -> DataFrame:
        schema, step = self.stages[name]
        if not self.finished(name):
            raise MissingStage(f"no finished table '{name}' in {self.root}: run {step} first")
        return self.spark.read.schema(schema).parquet(self.path(name))

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Overwrite the stage and return it as read back."""
        conform(df, self.stages[name][0]).write.mode("overwrite").parquet(self.path(name))
        return self.read(name)

    def get_or_build(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.read(name) if self.finished(name) else self.write(name, build())


def assign_batches(df: DataFrame, key: str, size: int = 5000) -> DataFrame:
    """``(key, row_index, batch)`` with ``batch = start_end`` by position in key order."""
    numbered = number_rows(df, key)
    total = numbered.count()
    start = F.col("row_index") - F.col("row_index") % size
    return numbered.select(
        key,
        "row_index",
        F.concat_ws("_", start, F.least(start + size, F.lit(total).cast("bigint"))).alias("batch"),
    )


def pending_batches(spark: SparkSession, assigned: DataFrame, path: str) -> DataFrame:
    """The assigned rows whose batch is not in the table yet."""
    if not path_exists(spark, path):
        return assigned
    done = spark.read.option("basePath", path).parquet(path).select("batch").distinct()
    return assigned.join(done, "batch", "left_anti")


def write_in_batches(
    df: DataFrame, path: str, key: str, size: int = 5000, max_jobs: int = 16, transform: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Write ``transform(df)`` partitioned by batch, in at most ``max_jobs`` jobs of neighbouring batches.

    Every job commits its own batches, so a run that fails continues after the last finished job and
    never repeats the (costly) transform of finished batches.
    """
    spark = df.sparkSession
    assigned = materialise(assign_batches(df, key, size), "batches")
    rows_per_job = size * max(1, math.ceil(assigned.count() / (size * max_jobs)))
    todo = pending_batches(spark, assigned, path).withColumn("_job", F.floor(F.col("row_index") / rows_per_job))
    spread = F.pmod(F.xxhash64(key), F.lit(1 + size // ROWS_PER_FILE))
    for job in sorted(r[0] for r in todo.select("_job").distinct().collect()):
        part = df.join(todo.where(F.col("_job") == job).select(key, "batch"), key)
        made = part if transform is None else transform(part)
        writer = made.repartition("batch", spread).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
    return spark.read.parquet(path)
