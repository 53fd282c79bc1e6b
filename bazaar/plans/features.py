"""One row of features per customer, their numeric codes and their scaled form."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.bands import age_group
from bazaar.functions.dates import purchase_day
from bazaar.functions.money import ratio, ratio_or_zero
from bazaar.operators.ranking import with_position

# Text columns that models read as numbers, and the columns that hold the numbers.
CODED_COLUMNS = {
    "customer_country": "customer_country_index",
    "customer_gender": "customer_gender_index",
    "age_group": "age_group_index",
}
SEGMENT_FEATURES = (
    "customer_total_revenue", "customer_average_order_value", "customer_total_profit", "customer_profit_margin",
    "customer_purchase_count", "customer_total_quantity", "customer_average_discount",
    "customer_promo_purchase_rate", "customer_weekend_purchase_rate", "customer_recency_days",
)


def camel_titles(df: DataFrame) -> DataFrame:
    """Feature tables under their published names (``CustomerTotalRevenue``, ``Customer ID``)."""
    names = {c: "".join(w.capitalize() for w in c.split("_")) for c in df.columns}
    return df.withColumnsRenamed({**names, "customer_id": "Customer ID"})


def exact_mean(column: Column) -> Column:
    """Sum first (exact), one division last."""
    return ratio(F.sum(column), F.count(column))


def share(flag: Column) -> Column:
    """Share of rows where the flag is true; an unknown flag is not true."""
    return ratio(F.count_if(flag), F.count("*"))


def customer_features(fact: DataFrame) -> DataFrame:
    """Thirteen measures per customer, three derived ones, no nulls among the numbers.

    Country and gender follow from the customer, so they are group keys: as aggregates of text they would make Spark
    sort all lines instead of hashing them.
    """
    last_day = fact.agg(F.max(purchase_day())).scalar()
    measures = fact.groupBy("customer_id", "customer_country", "customer_gender").agg(
        F.sum("line_total_usd").alias("_revenue"),
        F.count_distinct("invoice_id").alias("customer_purchase_count"),
        F.sum("quantity").alias("customer_total_quantity"),
        F.sum("profit_usd").alias("_profit"),
        exact_mean(F.col("profit_usd")).alias("customer_average_profit"),
        exact_mean(F.col("discount")).alias("customer_average_discount"),
        share(F.col("promo_active")).alias("customer_promo_purchase_rate"),
        share(F.col("is_weekend")).alias("customer_weekend_purchase_rate"),
        F.max(purchase_day()).alias("customer_last_purchase_date"),
        exact_mean(F.col("customer_age_at_purchase")).alias("customer_age"),
    )
    revenue, profit = F.col("_revenue"), F.col("_profit")
    return (
        measures.withColumns(
            {
                "customer_total_revenue": revenue.cast("double"),
                "customer_total_profit": profit.cast("double"),
                "customer_average_order_value": ratio(revenue, F.col("customer_purchase_count")),
                "customer_recency_days": F.datediff(last_day, F.col("customer_last_purchase_date")),
                "customer_profit_margin": ratio_or_zero(profit, revenue),
                "age_group": age_group(F.col("customer_age")),
            }
        )
        .drop("_revenue", "_profit")
        .fillna(0, [*SEGMENT_FEATURES, "customer_average_profit", "customer_age"])
    )


def category_index(features: DataFrame) -> DataFrame:
    """Code of every value of the coded columns: 0 for the most frequent, equal counts in alphabetical order.

    Counting and ranking are distributed: all values are put in one order, and a column's codes count from its first value.
    """
    rows = features.unpivot(["customer_id"], list(CODED_COLUMNS), "column_name", "value").filter("value is not null")
    counts = rows.groupBy("column_name", "value").agg(F.count("*").alias("customers"))
    order = [F.asc("column_name"), F.desc("customers"), F.asc("value")]
    placed = with_position(counts, order)
    first = placed.groupBy("column_name").agg(F.min("position").alias("first"))
    return placed.join(first, "column_name").select("column_name", "value", "customers", (F.col("position") - F.col("first")).alias("index"))


def with_codes(features: DataFrame) -> DataFrame:
    """Features and their codes; a null value gets the code after the last one.

    The codes are joined, so no list of distinct values passes through the driver.
    """
    index, rows = category_index(features), features
    for column, code in CODED_COLUMNS.items():
        own = index.filter(F.col("column_name") == column)
        codes = own.select(F.col("value").alias(column), F.col("index").cast("double").alias(code))
        after = own.agg(F.count("*").cast("double")).scalar()
        rows = rows.join(codes, column, "left").withColumn(code, F.coalesce(code, after))
    return rows.select(*features.columns, *CODED_COLUMNS.values())


def scaler_pipeline(columns: tuple[str, ...], handle_invalid: str) -> Pipeline:
    """Assemble and divide by the standard deviation, without moving the mean."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid=handle_invalid),
            StandardScaler(inputCol="features", outputCol="scaled_features", withStd=True, withMean=False),
        ]
    )


def scaled(features: DataFrame) -> DataFrame:
    """Segment features as ``features`` and ``scaled_features``; rows with a null are left out."""
    rows = features.select("customer_id", *SEGMENT_FEATURES)
    return scaler_pipeline(SEGMENT_FEATURES, "skip").fit(rows).transform(rows)


def sample_by_id(df: DataFrame, fraction: Column | float, seed: int = 42) -> DataFrame:
    """Customers drawn by a hash of the id: the same ones on every run, however the rows are partitioned."""
    return df.filter(F.pmod(F.xxhash64("customer_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(fraction) * 1_000_000)


def split_bucket(key: Column) -> Column:
    """0..99 from the id alone."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100


def train_test_split(df: DataFrame, train_percent: int = 80) -> DataFrame:
    return df.withColumn("is_train", split_bucket(F.col("customer_id")) < train_percent)
