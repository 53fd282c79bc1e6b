"""Interquartile-range filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.operators.ranking import with_running


def iqr_bounds(df: DataFrame, column: str, factor: float) -> DataFrame:
    """One row (low, high) from exact quartiles at any size. Both are null when the column has no value.

    A quartile is the least value that so many rows do not exceed. Equal values are counted first, and the counts summed up over
    ranges of values, so no task sees all of them. The counts are written on the way: this runs a job.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows"))
    placed = with_running(counts, [F.asc("value")], {"below": F.col("rows")})
    every = placed.agg(F.sum("rows")).scalar()
    reached = (F.col("below") + F.col("rows")) * 4
    q1, q3 = (F.min(F.when(reached >= every * k, F.col("value"))).cast("double") for k in (1, 3))
    quartiles = placed.agg(q1.alias("q1"), q3.alias("q3"))
    spread = F.lit(factor) * (F.col("q3") - F.col("q1"))
    return quartiles.select((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))


def iqr_filter(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Drop rows outside [Q1 - factor * IQR, Q3 + factor * IQR], column after column; nulls stay.

    The bounds are one scalar subquery: nothing travels through the driver, and no join is planned.
    """
    for column in columns:
        bounds = iqr_bounds(df, column, factor).select(F.struct("low", "high")).scalar()
        low, high = bounds.getField("low"), bounds.getField("high")
        value = F.col(column).cast("double")
        df = df.filter(value.isNull() | low.isNull() | value.between(low, high))
    return df
