"""Checks, filters, previews and slices of the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.runtime import number_rows


def length_stats(df: DataFrame, value: Column) -> DataFrame:
    """Mean, median, least and greatest of an integer value.

    The distinct values are counted first, spread over all tasks, and only this histogram reaches the
    exact median: a direct median would send every task's value map to a single task.
    """
    histogram = df.select(value.cast("bigint").alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    return histogram.agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("v", 0.5, F.col("n")).alias("median"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )


def at_least(df: DataFrame, value: Column, minimum: int) -> DataFrame:
    return df.where(value >= minimum)


def removed_count(df: DataFrame, value: Column, minimum: int) -> DataFrame:
    """How many rows the filter keeps and removes, in one pass."""
    return df.agg(
        F.count_if(value >= minimum).alias("kept"),
        (F.count(F.lit(1)) - F.count_if(value >= minimum)).alias("removed"),
    )


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail when nothing is left (stops at the first row found)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def preview(df: DataFrame, key: str, n: int, *columns: Column) -> DataFrame:
    """The first ``n`` rows by key: a top-n per task, no full sort."""
    return df.orderBy(key).limit(n).select(key, *columns)


def row_slice(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start..stop-1`` by position in key order, with ``row_index``; only keys are sorted."""
    wanted = number_rows(df, key).where(F.col("row_index").between(start, stop - 1))
    return df.join(wanted, key)


def point_lookup(df: DataFrame, key: str, value: object, column: str) -> DataFrame:
    """One cell by key; the key filter reaches the Parquet scan."""
    return df.where(F.col(key) == value).select(column)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def concat_tables(*parts: DataFrame) -> DataFrame:
    """Partial tables of the same columns, by name."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def concat_sources(*parts: DataFrame) -> DataFrame:
    """Tables whose columns may differ; missing ones become null."""
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first
