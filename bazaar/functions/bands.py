"""Named ranges used as group keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) and names of the age groups, lower bounds of the risk levels.
AGE_GROUPS = ((25, "18-24"), (35, "25-34"), (45, "35-44"), (55, "45-54"))
OLDEST_GROUP = "55+"
RISK_LEVELS = ((0.80, "HIGH"), (0.50, "MEDIUM"))
LOWEST_RISK = "LOW"
# Upper bounds (inclusive, in percent) and names of the promotion ranges.
NO_DISCOUNT = "No Discount"
DISCOUNT_RANGES = ((10, "1-10%"), (20, "11-20%"), (30, "21-30%"))
LARGEST_DISCOUNT = "30%+"


def _first_match(tests: list[tuple[Column, str]], otherwise: str) -> Column:
    (condition, name), *rest = tests
    chain = F.when(condition, name)
    for condition, name in rest:
        chain = chain.when(condition, name)
    return chain.otherwise(otherwise)


def age_group(age: Column) -> Column:
    """Under 18 counts as the youngest group, an unknown age as the oldest."""
    return _first_match([(age < bound, name) for bound, name in AGE_GROUPS], OLDEST_GROUP)


def risk_level(probability: Column) -> Column:
    return _first_match([(probability >= bound, name) for bound, name in RISK_LEVELS], LOWEST_RISK)


def _discount_range(percent: Column) -> Column:
    tests = [(percent == 0, NO_DISCOUNT)] + [(percent <= bound, name) for bound, name in DISCOUNT_RANGES]
    return _first_match(tests, LARGEST_DISCOUNT)


def discount_range(fraction: Column) -> Column:
    """Range of a promotion stored as a fraction 0..1; a line without promotion has no discount."""
    return _discount_range(F.coalesce(fraction, F.lit(0)) * 100)


def discount_range_as_written(fraction: Column) -> Column:
    """The older report's reading: the fraction is compared with percent bounds, and no promotion falls through to the
    last range. Kept so that its numbers can be reproduced."""
    return _discount_range(fraction)


def churn_name(label: Column) -> Column:
    return F.when(label == 1, "Churned").otherwise("Not Churned")


def day_type(is_weekend: Column) -> Column:
    return F.when(is_weekend, "Weekend").otherwise("Weekday")
