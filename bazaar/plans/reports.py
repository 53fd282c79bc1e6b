"""The fifteen sales reports over the fact, by name.

A report is ``fact -> DataFrame``. All sort orders are total: group keys break ties, so a top-k list is the same on
every run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.bands import day_type, discount_range, discount_range_as_written
from bazaar.functions.money import mean, total

def revenue() -> Column:
    return total("line_total_usd").alias("revenue_usd")


def profit() -> Column:
    return total("profit_usd").alias("profit_usd")


def units() -> Column:
    return F.sum("quantity").alias("units_sold")


def lines() -> Column:
    return F.count("*").alias("transactions")


def largest_first(df: DataFrame, measure: str, keys: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), *(F.asc_nulls_last(k) for k in keys))


def by_revenue(fact: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    return largest_first(fact.groupBy(*keys).agg(*measures), "revenue_usd", keys)


def with_distinct(
    one_row: DataFrame, fact: DataFrame, columns: dict[str, str], distinct: Callable[[str], Column] | None = None
) -> DataFrame:
    """one_row and the distinct counts of columns of the fact.

    Each is exact and comes from a grouping of its own column: several in one aggregate would repeat every line for each of
    them. With ``distinct`` it is that aggregate of the column instead.
    """

    def counted(c: str) -> Column:
        values = fact.select(c).filter(F.col(c).isNotNull()).distinct()
        return (fact.agg(distinct(c)) if distinct else values.agg(F.count("*"))).scalar()

    return one_row.select("*", *(counted(c).alias(name) for name, c in columns.items()))


def overview(fact: DataFrame, distinct: Callable[[str], Column] | None = None) -> DataFrame:
    """Exact by default; ``F.approx_count_distinct`` answers from sketches, without shuffling the ids."""
    columns = {"total_invoices": "invoice_id", "total_customers": "customer_id", "total_products": "product_id"}
    return with_distinct(fact.agg(F.count("*").alias("total_transactions")), fact, columns, distinct)


def sales_profit(fact: DataFrame) -> DataFrame:
    return fact.agg(
        total("line_total_usd").alias("total_revenue_usd"),
        total("profit_usd").alias("total_profit_usd"),
        mean("line_total_usd").alias("average_transaction_value_usd"),
    )


def by_year(fact: DataFrame) -> DataFrame:
    return fact.groupBy("purchase_year").agg(revenue(), profit(), units()).orderBy("purchase_year")


def by_month(fact: DataFrame) -> DataFrame:
    keys = ["purchase_year", "purchase_month"]
    return fact.groupBy(*keys).agg(revenue(), profit(), units()).orderBy(*keys)


def by_category(fact: DataFrame) -> DataFrame:
    return by_revenue(fact, ["product_category"], revenue(), profit(), units())


def by_subcategory(fact: DataFrame, k: int = 20) -> DataFrame:
    return by_revenue(fact, ["product_sub_category"], revenue(), profit(), units()).limit(k)


def top_products(fact: DataFrame, k: int = 10) -> DataFrame:
    return by_revenue(fact, ["product_id", "product_description"], revenue(), units(), profit()).limit(k)


def by_customer_country(fact: DataFrame, k: int = 20) -> DataFrame:
    customers = F.count_distinct("customer_id").alias("customers")
    return by_revenue(fact, ["customer_country"], revenue(), profit(), customers).limit(k)


def by_store_country(fact: DataFrame) -> DataFrame:
    return by_revenue(fact, ["store_country"], revenue(), profit(), F.count_distinct("store_id").alias("stores"))


def payment_methods(fact: DataFrame) -> DataFrame:
    average = mean("line_total_usd").alias("average_transaction_usd")
    return by_revenue(fact, ["payment_method"], lines(), revenue(), average)


def genders(fact: DataFrame) -> DataFrame:
    customers = F.count_distinct("customer_id").alias("customers")
    return by_revenue(fact, ["customer_gender"], customers, revenue(), profit())


def weekday_weekend(fact: DataFrame) -> DataFrame:
    named = fact.withColumn("day_type", day_type(F.col("is_weekend")))
    return by_revenue(named, ["day_type"], lines(), revenue(), profit())


def discounts(fact: DataFrame, band: Callable[[Column], Column] = discount_range) -> DataFrame:
    named = fact.withColumn("discount_range", band(F.col("promo_discount_pct")))
    return by_revenue(named, ["discount_range"], lines(), revenue(), profit())


def discounts_as_written(fact: DataFrame) -> DataFrame:
    return discounts(fact, discount_range_as_written)


def top_customers(fact: DataFrame, k: int = 10) -> DataFrame:
    return by_revenue(fact, ["customer_id", "customer_name", "customer_country"], revenue(), profit()).limit(k)


def top_stores(fact: DataFrame, k: int = 10) -> DataFrame:
    return by_revenue(fact, ["store_id", "store_name", "store_country"], revenue(), profit()).limit(k)


@dataclass(frozen=True)
class Report:
    title: str
    make: Callable[[DataFrame], DataFrame]


# Report names and titles that clients know.
REPORTS = {
    "data_overview": Report("Basic Data Overview", overview),
    "sales_profit": Report("Total Sales & Profit", sales_profit),
    "sales_by_year": Report("Sales by Year", by_year),
    "monthly_sales": Report("Monthly Sales Trend", by_month),
    "category_sales": Report("Sales by Product Category", by_category),
    "subcategory_sales": Report("Sales by Product Sub-Category", by_subcategory),
    "top_products": Report("Top 10 Products by Revenue", top_products),
    "customer_country_sales": Report("Sales by Customer Country", by_customer_country),
    "store_country_sales": Report("Sales by Store Country", by_store_country),
    "payment_methods": Report("Payment Method Analysis", payment_methods),
    "gender_analysis": Report("Customer Gender Analysis", genders),
    "weekday_weekend": Report("Weekday vs Weekend", weekday_weekend),
    "discount_analysis": Report("Discount Analysis", discounts),
    "top_customers": Report("Top 10 Customers by Revenue", top_customers),
    "top_stores": Report("Top 10 Stores by Revenue", top_stores),
}


def report(fact: DataFrame, name: str, max_rows: int | None = None) -> DataFrame:
    """One report by name; with ``max_rows``, at most so many rows of it."""
    if name not in REPORTS:
        raise KeyError(f"no report {name!r}; there are {', '.join(REPORTS)}")
    rows = REPORTS[name].make(fact)
    return rows if max_rows is None else rows.limit(max_rows)


def all_reports(fact: DataFrame, max_rows: int | None = None) -> dict[str, DataFrame]:
    return {name: report(fact, name, max_rows) for name in REPORTS}
