"""Data-quality and exploration queries over the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.money import mean, ratio, total
from bazaar.plans.reports import largest_first

# Ages outside this range are not believable.
LOWEST_AGE, HIGHEST_AGE = 0, 100


def _revenue() -> Column:
    return total("line_total_usd").alias("total_revenue_usd")


def _profit() -> Column:
    return total("profit_usd").alias("total_profit_usd")


def _average() -> Column:
    return mean("line_total_usd").alias("avg_line_value_usd")


def _lines() -> Column:
    return F.count("*").alias("transactions")


def _margin() -> Column:
    return F.round(ratio(F.sum("profit_usd"), F.sum("line_total_usd")) * 100, 1).alias("margin_pct")


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column and the row count, from one aggregate over all columns."""
    counts = df.agg(F.count("*").alias("total_rows"), *(F.count_if(df[c].isNull()).alias(c) for c in df.columns))
    return counts.unpivot(["total_rows"], df.columns, "column_name", "null_count")


def negative_profit(fact: DataFrame) -> DataFrame:
    negative = F.count_if(F.col("profit_usd") < 0)
    return fact.agg(negative.alias("lines"), ratio(negative, F.count("*")).alias("share"))


def negative_profit_lines(fact: DataFrame, n: int | None = None) -> DataFrame:
    """All losses, the largest first; with n, the first n."""
    rows = (
        fact.filter("profit_usd < 0")
        .select(
            "invoice_id", "line", "product_category", "promo_active", "unit_price_usd", "production_cost", "profit_usd"
        )
        .orderBy("profit_usd", "invoice_id", "line")
    )
    return rows if n is None else rows.limit(n)


def promo_without_discount(fact: DataFrame, n: int | None = None) -> DataFrame:
    """Lines under a promotion that carry no discount of their own; with n, the first n."""
    rows = (
        fact.filter(F.col("promo_active") & (F.col("discount") == 0))
        .select("invoice_id", "line", "product_category", "promo_discount_pct", "discount", "line_total_usd")
        .orderBy("invoice_id", "line")
    )
    return rows if n is None else rows.limit(n)


def overall(fact: DataFrame) -> DataFrame:
    return fact.agg(
        total("line_total_usd").alias("total_revenue"),
        total("profit_usd").alias("total_profit"),
        mean("line_total_usd").alias("avg_line_value"),
        F.count("*").alias("line_items"),
        F.count_distinct("invoice_id").alias("invoices"),
    )


def store_countries(fact: DataFrame) -> DataFrame:
    keys = ["store_country"]
    return largest_first(fact.groupBy(*keys).agg(_revenue(), _profit(), _lines()), "total_revenue_usd", keys)


def payment_methods(fact: DataFrame) -> DataFrame:
    keys = ["payment_method"]
    return largest_first(fact.groupBy(*keys).agg(_revenue(), _lines()), "total_revenue_usd", keys)


def months(fact: DataFrame) -> DataFrame:
    keys = ["purchase_year", "purchase_month"]
    return fact.groupBy(*keys).agg(_revenue(), _lines()).orderBy(*keys)


def weekend(fact: DataFrame) -> DataFrame:
    return fact.groupBy("is_weekend").agg(_revenue(), _average(), _lines())


def categories(fact: DataFrame) -> DataFrame:
    return fact.select("product_category").distinct()


def top_subcategories(fact: DataFrame, n: int = 10) -> DataFrame:
    """``units_sold`` counts lines, as the existing reading of this list does."""
    keys = ["product_category", "product_sub_category"]
    sums = fact.groupBy(*keys).agg(_revenue(), F.count("*").alias("units_sold"))
    return largest_first(sums, "total_revenue_usd", keys).limit(n)


def margin_by_category(fact: DataFrame) -> DataFrame:
    sums = fact.groupBy("product_category").agg(_profit(), _revenue(), _margin())
    return sums.orderBy("margin_pct", "product_category")


def genders(fact: DataFrame) -> DataFrame:
    return fact.groupBy("customer_gender").agg(
        _revenue(), F.count_distinct("customer_id").alias("distinct_customers")
    )


def ages(fact: DataFrame) -> DataFrame:
    age = "customer_age_at_purchase"
    mean_age = F.round(ratio(F.sum(age), F.count(age)), 1)
    return fact.agg(F.min(age).alias("min_age"), mean_age.alias("avg_age"), F.max(age).alias("max_age"))


def implausible_ages(fact: DataFrame, n: int | None = None) -> DataFrame:
    rows = (
        fact.filter(~F.col("customer_age_at_purchase").between(LOWEST_AGE, HIGHEST_AGE))
        .select("customer_id", "date_of_birth", "date", "customer_age_at_purchase", "invoice_id", "line")
        .orderBy("customer_id", "date", "invoice_id", "line")
    )
    return rows if n is None else rows.limit(n)


def top_customers(fact: DataFrame, n: int = 10) -> DataFrame:
    keys = ["customer_id", "customer_name"]
    sums = fact.groupBy(*keys).agg(
        total("line_total_usd").alias("total_spend_usd"), F.count_distinct("invoice_id").alias("invoices")
    )
    return largest_first(sums, "total_spend_usd", keys).limit(n)


def top_stores(fact: DataFrame, n: int = 20) -> DataFrame:
    keys = ["store_name", "store_city", "store_country"]
    return largest_first(fact.groupBy(*keys).agg(_revenue(), _lines()), "total_revenue_usd", keys).limit(n)


def top_employees(fact: DataFrame, n: int = 10) -> DataFrame:
    keys = ["employee_name", "employee_position", "store_name"]
    return largest_first(fact.groupBy(*keys).agg(_revenue(), _lines()), "total_revenue_usd", keys).limit(n)


def promo_vs_non(fact: DataFrame) -> DataFrame:
    return fact.groupBy("promo_active").agg(_revenue(), _average(), _margin(), _lines())


def promo_distribution(fact: DataFrame) -> DataFrame:
    return (
        fact.filter("promo_active")
        .groupBy("promo_discount_pct")
        .agg(F.count("*").alias("lines"))
        .orderBy("promo_discount_pct")
    )
