"""Tables a stacked-area chart draws from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.urls import year_date


def parse_series(series: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """A series as read from a file: year strings to dates, values to numbers."""
    return series.withColumn(date, year_date(F.col(date))).withColumn(value, F.col(value).cast("double"))


def cumulative_curve(per_year: DataFrame, year: str = "year", value: str = "count", step: float = 0.01) -> DataFrame:
    """Running total of ``value * step`` by year.

    The window has no partition: call it on one row per year, never on cases.
    """
    upto = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_year.select(year, value, F.sum(F.col(value) * step).over(upto).alias("cumulative"))


def stack_layers(trend: DataFrame, date: str = "date", key: str = "key", value: str = "value") -> DataFrame:
    """Each layer's baseline ``y0``: the sum of the layers before it on that date (one row per layer)."""
    before = Window.partitionBy(date).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return trend.select(
        date, key, F.col(value).alias("y"), F.coalesce(F.sum(value).over(before), F.lit(0)).alias("y0")
    )


def first_per_key(trend: DataFrame, key: str = "key", date: str = "date") -> DataFrame:
    """The earliest row of every layer: a minimum per key, combined per task before the shuffle."""
    rest = [c for c in trend.columns if c not in (key, date)]
    first = F.min(F.struct(date, *rest)).alias("_first")
    return trend.groupBy(key).agg(first).select(key, "_first.*").select(*trend.columns)


def chart_extents(stacked: DataFrame) -> DataFrame:
    """Axis limits: first and last date, largest yearly value, highest stack; one pass over the layers."""
    per_date = stacked.groupBy("date").agg(F.sum("y").alias("value"), F.max(F.col("y0") + F.col("y")).alias("top"))
    return per_date.agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("value").alias("max_value"), F.max("top").alias("max_stack")
    )
