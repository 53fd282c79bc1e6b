"""Calendar columns of a purchase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Mean length of a year, and Sunday and Saturday in Spark's day numbering.
DAYS_PER_YEAR = 365.25
WEEKEND_DAYS = (1, 7)
DATE_PARTS = ("purchase_day_of_week", "purchase_month", "purchase_year", "is_weekend")


def purchase_day() -> Column:
    return F.to_date("date")


def age_at_purchase() -> Column:
    return F.floor(F.datediff(purchase_day(), F.col("date_of_birth")) / F.lit(DAYS_PER_YEAR)).cast("int")


def add_date_parts(tx: DataFrame) -> DataFrame:
    return tx.withColumns(
        {
            "purchase_day_of_week": F.dayofweek("date"),
            "purchase_month": F.month("date"),
            "purchase_year": F.year("date"),
            "is_weekend": F.dayofweek("date").isin(*WEEKEND_DAYS),
        }
    )
