"""Matching of sales lines with the promotion calendar.

A promotion covers a (category, sub-category) for a range of days; a line gets the largest discount covering its day.
Joining lines with ranges would compare each line with every promotion of its category and then pick a winner per line.
Instead the ranges become days, the winner per day is picked once, and the lines need one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from bazaar.functions.dates import purchase_day

PROMO_KEY = ("product_category", "product_sub_category", "_purchase_day")


def sales_days(transactions: DataFrame) -> DataFrame:
    """One row: first and last day with a sale. Reads a single column."""
    return transactions.agg(F.min(purchase_day()).alias("first_day"), F.max(purchase_day()).alias("last_day"))


def promo_days(discounts: DataFrame, days: DataFrame) -> DataFrame:
    """One row per promotion and day, cut to the days that have sales, so that an open-ended promotion (end 9999-12-31)
    does not grow into millions of rows."""
    span = days.select(F.struct("first_day", "last_day")).scalar()
    first = F.greatest("start", span.getField("first_day"))
    last = F.least("end", span.getField("last_day"))
    return (
        discounts.filter(F.col("category").isNotNull() & F.col("sub_category").isNotNull())
        .withColumns({"_first": first, "_last": last})
        .filter("_first <= _last")
        .select(
            F.col("category").alias("product_category"),
            F.col("sub_category").alias("product_sub_category"),
            F.explode(F.sequence("_first", "_last")).alias("_purchase_day"),
            F.col("discount").alias("promo_discount_pct"),
        )
    )


def promo_calendar(discounts: DataFrame, days: DataFrame) -> DataFrame:
    """Largest discount per category, sub-category and day."""
    return (
        promo_days(discounts, days).groupBy(*PROMO_KEY).agg(F.max("promo_discount_pct").alias("promo_discount_pct"))
    )


def _promo_active() -> Column:
    return F.col("promo_discount_pct").isNotNull()


def join_active_promos(tx: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``promo_discount_pct`` and ``promo_active``; keeps every line once, because the calendar key is unique."""
    return (
        tx.withColumn("_purchase_day", purchase_day())
        .join(calendar, list(PROMO_KEY), "left")
        .drop("_purchase_day")
        .withColumn("promo_active", _promo_active())
    )


def best_promo_per_line(tx: DataFrame, days_of_promos: DataFrame) -> DataFrame:
    """The same result by ranking: every promotion of the day is attached and the best one per line is kept."""
    window = Window.partitionBy("invoice_id", "line").orderBy(F.desc_nulls_last("promo_discount_pct"))
    return (
        tx.withColumn("_purchase_day", purchase_day())
        .join(days_of_promos, list(PROMO_KEY), "left")
        .withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1")
        .drop("_rank", "_purchase_day")
        .withColumn("promo_active", _promo_active())
    )
