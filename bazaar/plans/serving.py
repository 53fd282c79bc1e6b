"""Result tables for clients, over the fact and over churn scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaar.functions.bands import LOWEST_RISK, RISK_LEVELS, churn_name
from bazaar.functions.money import ratio_or_zero
from bazaar.plans.reports import with_distinct

# Lengths of the two customer lists.
HIGH_RISK_ROWS = 100
DISTRIBUTION_ROWS = 2_000

LEVELS = (*(name for _, name in RISK_LEVELS), LOWEST_RISK)


def _sum_or_zero(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def summary(fact: DataFrame) -> DataFrame:
    revenue, profit = _sum_or_zero("line_total_usd"), _sum_or_zero("profit_usd")
    sums = fact.agg(
        F.count("*").alias("total_transactions"),
        revenue.cast("double").alias("total_revenue"),
        profit.cast("double").alias("total_profit"),
        ratio_or_zero(profit, revenue).alias("profit_margin"),
    )
    counted = with_distinct(sums, fact, {"unique_customers": "customer_id", "unique_orders": "invoice_id"})
    return counted.withColumn("average_order_value", ratio_or_zero(F.col("total_revenue"), F.col("unique_orders")))


def _level_counts() -> dict[str, Column]:
    return {level: F.count_if(F.col("risk_level") == level) for level in LEVELS}


def customer_analytics(scores: DataFrame) -> DataFrame:
    """Customers per risk level and per label; every level is listed, also with 0 customers."""
    labels = {name: F.count_if(F.col("churn_label") == value) for value, name in ((1, "churned"), (0, "active"))}
    names = [churn_name(F.lit(1)), churn_name(F.lit(0))]
    counts = scores.agg(*(c.alias(name) for name, c in (_level_counts() | labels).items()))
    rows = [("risk_level", F.lit(level), F.col(level)) for level in LEVELS]
    rows += [("churn_label", text, F.col(column)) for text, column in zip(names, labels)]
    entries = F.array(
        *(F.struct(F.lit(kind).alias("kind"), text.alias("name"), n.alias("customers")) for kind, text, n in rows)
    )
    return counts.select(F.inline(entries))


def churn_summary(scores: DataFrame) -> DataFrame:
    churn = F.count_if(F.col("predicted_churn") == 1)
    levels = [c.alias(f"{name.lower()}_risk_customers") for name, c in _level_counts().items()]
    return scores.agg(
        F.count("*").alias("total_customers"),
        churn.alias("predicted_churn_customers"),
        F.coalesce(F.avg("churn_probability"), F.lit(0.0)).alias("average_churn_probability"),
        ratio_or_zero(churn, F.count("*")).alias("predicted_churn_rate"),
        *levels,
    )


def _likeliest(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("churn_probability"), "customer_id").limit(n)


def high_risk_customers(scores: DataFrame, n: int = HIGH_RISK_ROWS) -> DataFrame:
    rows = scores.filter(F.col("risk_level") == RISK_LEVELS[0][1])
    return _likeliest(rows.select("customer_id", "churn_probability", "risk_level", "predicted_churn"), n)


def churn_distribution(scores: DataFrame, n: int = DISTRIBUTION_ROWS) -> DataFrame:
    return _likeliest(scores.select("customer_id", "churn_probability", "risk_level"), n)
