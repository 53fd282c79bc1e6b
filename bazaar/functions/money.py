"""Currency conversion and exact money arithmetic."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.contract import MONEY

# US dollars for one unit of each currency. Other currencies have no rate and stay without a USD value.
FX_RATES_TO_USD = {"USD": "1.00", "EUR": "1.08", "GBP": "1.27", "CNY": "0.14"}


def fx_rate(currency: Column) -> Column:
    pairs = [F.lit(x) for code, rate in FX_RATES_TO_USD.items() for x in (code, Decimal(rate))]
    return F.create_map(*pairs)[currency]


def add_usd_columns(tx: DataFrame) -> DataFrame:
    """Dollar values in whole cents; one of more than sixteen digits before the point has no value, as without a rate."""
    rate = F.col("fx_rate_to_usd")
    return tx.withColumn("fx_rate_to_usd", fx_rate(F.col("currency"))).withColumns(
        {
            f"{name}_usd": F.round(F.col(name) * rate, 2).try_cast(MONEY)
            for name in ("unit_price", "line_total", "invoice_total")
        }
    )


def profit_usd() -> Column:
    """Dollar value of the line less production cost of the units sold; costs are already in dollars."""
    return F.round(F.col("line_total_usd") - F.col("production_cost") * F.col("quantity"), 2)


def total(name: str) -> Column:
    """Rounded sum as double. The sum itself is decimal, so no order of addition changes it."""
    return F.round(F.sum(name), 2).cast("double")


def mean(name: str) -> Column:
    """Rounded mean as double. The quotient of exact sum and count has enough digits to be rounded once."""
    return F.round(F.try_divide(F.sum(name), F.count(name)), 2).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, null when the denominator is zero or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is positive, otherwise 0."""
    return F.when(denominator > 0, ratio(numerator, denominator)).otherwise(F.lit(0.0))
