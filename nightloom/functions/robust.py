"""Robust statistics with the upper median: the sorted element at floor(n / 2), 0 of nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGMA = 1.4826  # from a median absolute deviation to a Gaussian sigma


def median_of(values: Column) -> Column:
    """Upper median of an array column."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def mad_of(values: Column) -> Column:
    """Sigma by the median absolute deviation of an array column."""
    middle = F.array(median_of(values))
    return F.get(F.transform(middle, lambda m: median_of(F.transform(values, lambda v: F.abs(v - m))) * SIGMA), 0)


def upper_median(value) -> Column:
    """Aggregate for groups that fit an array (a session, a tile, a frame's stars)."""
    return median_of(F.collect_list(value))


def upper_mad(value) -> Column:
    return mad_of(F.collect_list(value))


def wide_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, out: upper medians of groups of any size, by row number in a sorted, spillable window."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    sizes = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value, rank.alias("__r"))
    return ranked.join(sizes, keys).where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select(*keys, F.col(value).alias(out))


def wide_mad(df: DataFrame, keys: list[str], value: str, median: str, mad: str) -> DataFrame:
    """keys, median, mad (sigma) of groups of any size."""
    centre = wide_median(df, keys, value, median)
    away = df.join(centre, keys).select(*keys, F.abs(F.col(value) - F.col(median)).alias("__away"))
    return centre.join(wide_median(away, keys, "__away", "__mad"), keys).select(*keys, median, (F.col("__mad") * SIGMA).alias(mad))
