"""The wide sales fact: one row per clean transaction line.

Every join is a left join on the unique key of a clean table, so the number of lines never changes. No join carries a
broadcast hint: Spark broadcasts a table when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and
otherwise shuffles both sides, where adaptive execution splits the partitions of a hot customer or product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.dates import DATE_PARTS, add_date_parts, age_at_purchase
from bazaar.functions.money import add_usd_columns, profit_usd
from bazaar.operators.promotions import join_active_promos
from bazaar.sources.sinks import gather_months


@dataclass(frozen=True)
class Dimension:
    """A clean table that lines refer to: its key, and its columns under the names that they get in the fact."""

    key: str
    columns: dict[str, str]


# The attributes that a line of the fact carries.
DIMENSIONS = {
    "customers": Dimension(
        "customer_id",
        {
            "date_of_birth": "date_of_birth",
            **{c: f"customer_{c}" for c in ("name", "email", "city", "country", "gender", "job_title")},
        },
    ),
    "products": Dimension(
        "product_id",
        {
            "category": "product_category",
            "sub_category": "product_sub_category",
            "description_en": "product_description",
            "production_cost": "production_cost",
        },
    ),
    "stores": Dimension(
        "store_id",
        {"store_name": "store_name", **{c: f"store_{c}" for c in ("city", "country", "latitude", "longitude")}},
    ),
    "employees": Dimension("employee_id", {c: f"employee_{c}" for c in ("name", "position")}),
}


def join_dimension(tx: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Lines with the attributes of one dimension. Null and unknown keys keep their line, with null attributes.

    ``rows`` must have each key once, as every clean table does; a repeated key would repeat its lines.
    """
    dimension = DIMENSIONS[name]
    attributes = (F.col(c).alias(new) for c, new in dimension.columns.items())
    return tx.join(rows.select(dimension.key, *attributes), dimension.key, "left")


def in_order(tx: DataFrame, order: str, key: str) -> DataFrame:
    """Lines in an order within their tasks, while they are thin; a left join on ``key`` that hashes its other side keeps it.

    Lines that are widened in the order of their dates fill one file of a month after the other. In any other order a task goes from
    file to file with every line, each with buffers and a dictionary for every column. Spark drops a sort below a join unless
    something like the ``inline`` stands between.
    """
    rest = [c for c in tx.columns if c != key]
    return tx.sortWithinPartitions(order).select(key, F.inline(F.array(F.struct(*rest))))


def add_customer_age(tx: DataFrame) -> DataFrame:
    return tx.withColumn("customer_age_at_purchase", age_at_purchase())


def add_profit(tx: DataFrame) -> DataFrame:
    return tx.withColumn("profit_usd", profit_usd())


def fact_columns(lines: list[str]) -> list[str]:
    """The columns of the fact in their order, for lines with the given columns."""
    usd = ["fx_rate_to_usd", "unit_price_usd", "line_total_usd", "invoice_total_usd"]
    of = {name: list(d.columns.values()) for name, d in DIMENSIONS.items()}
    keys = [DIMENSIONS[d].key for d in ("customers", "products", "employees", "stores")]
    promo = ["product_category", "product_sub_category"]
    first = ["customer_id", *promo, *keys[1:]]
    rest = [c for c in (*lines, *usd) if c not in keys]
    products = [c for c in of["products"] if c not in promo]
    derived = ["customer_age_at_purchase", "profit_usd", *DATE_PARTS]
    return [*first, *rest, *of["stores"], *of["employees"], *products, "promo_discount_pct", "promo_active", *of["customers"], *derived]


def build_fact(
    clean: dict[str, DataFrame],
    calendar: DataFrame,
    by_month: bool = False,
    joined: tuple[DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """Lines with USD values, attributes of customer, product, store and employee, promotion and derived columns.

    Lines are widened late, because every join that is not broadcast shuffles them as wide as they are: the dimensions that
    grow most come first, and what follows from a line alone is derived last. With ``by_month`` rows are gathered for a
    table partitioned by month before anything is joined, which suits joins that are broadcast.

    ``joined`` may be lines that have the attributes of some dimensions already, with the names of these; they are not gathered.
    """
    lines = clean["transactions"]
    widened, done = joined or (gather_months(add_date_parts(lines)) if by_month else lines, ())
    for name in ("customers", "products", "employees", "stores"):
        if name not in done:
            widened = join_dimension(widened, clean[name], name)
    derived = (
        widened.transform(join_active_promos, calendar)
        .transform(add_usd_columns)
        .transform(add_customer_age)
        .transform(add_profit)
        .transform(add_date_parts)
    )
    return derived.select(*fact_columns(lines.columns))


def in_period(year: int | None = None, sub_category: str | None = None, country: str | None = None) -> Column:
    """Optional report filters; the year selects partitions of the written fact."""
    condition = F.lit(True)
    for name, value in (("purchase_year", year), ("product_sub_category", sub_category), ("store_country", country)):
        if value is not None:
            condition &= F.col(name) == value
    return condition
