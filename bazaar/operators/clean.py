"""Cleaning of the six raw tables.

A table is described by how its columns are typed, which rows are valid, what the key is and which row of a key
survives. Cleaning and the quality report read the same description.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.contract import TABLES
from bazaar.functions.text import null_placeholders, to_day, to_id, to_instant, to_price, to_whole
from bazaar.operators.dedup import distinct_rows, keep_first
from bazaar.operators.outliers import iqr_filter

# The outlier factor of costs, and in the functions below the text columns of each table.
COST_OUTLIER_FACTOR = 3.0


def _typed_customers(raw: DataFrame) -> DataFrame:
    texts = ["name", "email", "telephone", "city", "country", "gender", "job_title"]
    return null_placeholders(raw, texts).withColumns(
        {"customer_id": to_id("customer_id"), "date_of_birth": to_day("date_of_birth"), "email": F.lower("email")}
    )


def _typed_products(raw: DataFrame) -> DataFrame:
    languages = ["pt", "de", "fr", "es", "en", "zh"]
    texts = ["category", "sub_category", *(f"description_{x}" for x in languages), "color", "sizes"]
    return null_placeholders(raw, texts).withColumns(
        {
            "product_id": to_id("product_id"),
            "production_cost": to_price("production_cost"),
            "sizes": F.split("sizes", r"\|"),
        }
    )


def _typed_stores(raw: DataFrame) -> DataFrame:
    return null_placeholders(raw, ["country", "city", "store_name", "zip_code"]).withColumns(
        {
            "store_id": to_id("store_id"),
            "number_of_employees": to_whole("number_of_employees"),
            "latitude": F.col("latitude").try_cast("double"),
            "longitude": F.col("longitude").try_cast("double"),
        }
    )


def _typed_employees(raw: DataFrame) -> DataFrame:
    return null_placeholders(raw, ["name", "position"]).withColumns(
        {"employee_id": to_id("employee_id"), "store_id": to_id("store_id")}
    )


def _typed_discounts(raw: DataFrame) -> DataFrame:
    return null_placeholders(raw, ["description", "category", "sub_category"]).withColumns(
        {"start": to_day("start"), "end": to_day("end"), "discount": to_price("discount")}
    )


def _typed_transactions(raw: DataFrame) -> DataFrame:
    texts = [
        "invoice_id", "size", "color", "currency", "currency_symbol", "sku", "transaction_type", "payment_method",
    ]
    return null_placeholders(raw, texts).withColumns(
        {
            "line": to_whole("line"),
            "quantity": to_whole("quantity"),
            "date": to_instant("date"),
            **{c: to_id(c) for c in ("customer_id", "product_id", "store_id", "employee_id")},
            **{c: to_price(c) for c in ("unit_price", "discount", "line_total", "invoice_total")},
        }
    )


def _present(*names: str) -> Column:
    condition = F.lit(True)
    for name in names:
        condition &= F.col(name).isNotNull()
    return condition


@dataclass(frozen=True)
class TableRule:
    typed: Callable[[DataFrame], DataFrame]
    valid: Callable[[], Column]
    ids: tuple[str, ...]
    key: tuple[str, ...] = ()  # empty: the whole row
    first: tuple[str, ...] = ()  # survivor of a key: smallest by these columns, then by all others


RULES = {
    "customers": TableRule(_typed_customers, lambda: _present("customer_id"), ("customer_id",), ("customer_id",)),
    "products": TableRule(
        _typed_products,
        lambda: _present("product_id") & (F.col("production_cost") >= 0),
        ("product_id",),
        ("product_id",),
    ),
    "stores": TableRule(
        _typed_stores,
        lambda: _present("store_id") & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180),
        ("store_id",),
        ("store_id",),
    ),
    "employees": TableRule(
        _typed_employees,
        lambda: _present("employee_id", "store_id"),
        ("employee_id", "store_id"),
        ("employee_id",),
    ),
    "discounts": TableRule(
        _typed_discounts,
        lambda: (F.col("end") >= F.col("start")) & F.col("discount").between(0, 1),
        (),
    ),
    "transactions": TableRule(
        _typed_transactions,
        lambda: _present("invoice_id", "customer_id", "product_id")
        & F.col("discount").between(0, 1)
        & (F.col("quantity") > 0)
        & (F.col("unit_price") >= 0)
        & (F.col("line_total") >= 0),
        ("invoice_id", "customer_id", "product_id"),
        ("invoice_id", "line"),
        ("product_id", "store_id", "line_total", "unit_price"),
    ),
}


def _apart(rows: DataFrame) -> DataFrame:
    """The same rows; Spark generates what makes them and what follows as methods of their own, and no filter passes."""
    return rows.select(F.inline(F.array(F.struct(*rows.columns))))


def typed_rows(table: str, raw: DataFrame) -> DataFrame:
    """Raw rows with the types of the table, each value worked out once.

    A filter over typed columns would be pushed below the projection that types them, and its casts done twice. That, or what makes
    the raw rows, would share a method with the casts, too long for the JVM to compile.
    """
    return _apart(RULES[table].typed(_apart(raw)))


def valid_rows(table: str, raw: DataFrame) -> DataFrame:
    """Typed rows that pass the rules of the table; a rule over a null fails."""
    return typed_rows(table, raw).filter(RULES[table].valid())


def unique_rows(table: str, raw: DataFrame) -> DataFrame:
    rule = RULES[table]
    rows = valid_rows(table, raw)
    return keep_first(rows, rule.key, rule.first) if rule.key else distinct_rows(rows)


def clean(table: str, raw: DataFrame) -> DataFrame:
    """The clean form of one raw table (snake_case columns, all strings)."""
    rows = unique_rows(table, raw)
    return iqr_filter(rows, ["production_cost"], COST_OUTLIER_FACTOR) if table == "products" else rows


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {table: clean(table, raw[table]) for table in TABLES}


def quality_report(raw: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows before and after, dropped, and why. One pass over each raw table.

    Products need a second one, because their outlier bounds depend on the whole table.
    """
    parts = []
    for table in TABLES:
        rule = RULES[table]
        typed = rule.typed(raw[table])  # not typed_rows: only the columns that rules and key read are worked out
        valid = F.coalesce(rule.valid(), F.lit(False))
        no_id = ~_present(*rule.ids)
        key = F.struct(*(rule.key or typed.columns))
        stats = typed.agg(
            F.count("*").alias("rows_before"),
            F.count_if(no_id).alias("null_id_rows"),
            F.count_if(~no_id & ~valid).alias("rule_rows"),
            F.count_if(valid).alias("_valid"),
            F.count_distinct(F.when(valid, key)).alias("_unique"),
        )
        kept = clean(table, raw[table]).agg(F.count("*")).scalar() if table == "products" else F.col("_unique")
        parts.append(
            stats.withColumn("rows_after", kept).select(
                F.lit(table).alias("table_name"),
                "rows_before",
                "rows_after",
                (F.col("rows_before") - F.col("rows_after")).alias("rows_dropped"),
                "null_id_rows",
                "rule_rows",
                (F.col("_valid") - F.col("_unique")).alias("duplicate_rows"),
                (F.col("_unique") - F.col("rows_after")).alias("outlier_rows"),
            )
        )
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def unconverted_currencies(fact: DataFrame) -> DataFrame:
    """Lines that count but carry no USD value, by currency."""
    return (
        fact.filter(F.col("fx_rate_to_usd").isNull())
        .groupBy("currency")
        .agg(F.count("*").alias("lines"))
    )
