"""The fact as a view for SQL under titled names, so that existing queries (`Line Total USD`) run unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bazaar.contract import decimals_to_double, to_titles

FACT_VIEW = "fact_transactions"


def register_fact_view(fact: DataFrame, name: str = FACT_VIEW) -> None:
    to_titles(decimals_to_double(fact)).createOrReplaceTempView(name)
