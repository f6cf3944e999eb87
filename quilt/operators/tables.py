"""Transforms of benchmark result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_mean(df: DataFrame, idx: str, value: str, size: int) -> DataFrame:
    """Mean of every ``size`` consecutive rows, to 4 decimals."""
    return df.groupBy(F.expr(f"{idx} div {size}").alias("grp")).agg(F.round(F.avg(value), 4).alias("mean"))


def sort_in_chunk(df: DataFrame, idx: str, key: str, size: int) -> DataFrame:
    """New positions when rows are sorted by key inside chunks of ``size``; ties keep their order."""
    w = F.row_number().over(_chunk(idx, key, size))
    return df.select(idx, key, (F.expr(f"{idx} div {size}") * size + w - 1).cast("long").alias("pos"))


def _chunk(idx: str, key: str, size: int):
    from pyspark.sql import Window

    return Window.partitionBy(F.expr(f"{idx} div {size}")).orderBy(key, idx)


def slice_rows(df: DataFrame, idx: str, start: int, stop: int) -> DataFrame:
    return df.where((F.col(idx) >= start) & (F.col(idx) < stop))


def speedup(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """b / a to 2 decimals on equal keys; null where a is 0."""
    return a.join(b.withColumnRenamed(value, "__b"), on).select(*on, F.round(F.try_divide(F.col("__b"), F.col(value)), 2).alias("speedup"))
