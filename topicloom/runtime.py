"""Session helpers: shared scratch tables, path checks and size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_INPUT_BYTES = 1 << 30


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder.

    A cluster names a shared folder in ``spark.checkpoint.dir``; without one this raises there, since a
    folder of one machine would be invisible to the others.  Only a local session that names none
    (tests on one machine) gets a temporary folder.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is not None:
        return root
    if not is_local(spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="topicloom-"))
    return spark.sparkContext.getCheckpointDir()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process and so share their folders."""
    return master == "local" or master.startswith("local[")


def materialise(df: DataFrame, label: str, schema: T.StructType | str | None = None, partitions: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a table in the scratch folder and read it back.

    Cuts the lineage with a table that outlives any executor, and gives Catalyst real sizes to
    pick join strategies from.  ``schema`` reads the table back under other types; ``partitions`` are columns
    with a folder for each value.
    """
    path = f"{scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=partitions)
    table = df.sparkSession.read.schema(df.schema if schema is None else schema).parquet(path)
    table._scratch_path = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table made by ``materialise`` that nothing reads any more."""
    path = getattr(table, "_scratch_path", None)
    if path is not None:
        delete_path(table.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan's result."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def sized(df: DataFrame, label: str = "dimension") -> DataFrame:
    """A small side of a join with its true size known to Catalyst.

    A plan estimated below the broadcast threshold stays as it is.  Any other is written once, so that
    Catalyst broadcasts it by its real size, or joins it without a broadcast when it really is large.
    """
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df if planned_bytes(df) <= threshold else materialise(df, label)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that is computed once per row, also when later steps filter on it.

    A filter on an ordinary column is pushed below it with the whole expression, which then runs twice.
    It is not pushed below a generated column; a one-element array generates exactly one row.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores.

    A small file holds a single row group and so lands in one task, however many cores there are.
    Inputs above the bound already come in many splits and are left as they are: no shuffle.
    """
    if planned_bytes(df) > SMALL_INPUT_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def number_rows(df: DataFrame, key: str, name: str = "row_index") -> DataFrame:
    """``(key, name)``: the 0-based position of every unique ``key`` in ascending order.

    Range-partitioned sort of the key alone, numbered inside each partition, plus the partition's
    offset.  The placed keys are written once, so both uses see the same partitions; only the
    per-partition counts (one row each) pass through a single task.
    """
    placed = materialise(
        df.select(key)
        .repartitionByRange(F.col(key))
        .sortWithinPartitions(key)
        .select(
            key,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"),
        ),
        "numbered",
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(_preceding("_part"))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(offsets), "_part").select(
        key, (F.col("_start") + F.col("_pos")).alias(name)
    )


def _preceding(order: str):
    from pyspark.sql import Window

    return Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
