"""Running sums and ranks over a whole table without bringing it to one task.

Rows are dealt into ranges of their order; each range is summed up, the sums of the ranges before it are its offset, and a
window inside each range does the rest. Only one row per range meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaar.sources.files import kept


def with_running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name in ``sums``, the sum of that column over all rows before the row (0 for the first).

    Rows that the order does not tell apart lie in one range, in any order among themselves; give an order without ties, or
    group by its columns first.
    """
    placed = df.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), **{f"_{n}": c for n, c in sums.items()}})
    placed = kept(placed, "ranges")
    before = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col("_range").alias("_at")).agg(*(F.sum(f"_{n}").alias(n) for n in sums))
    offsets = totals.select("_at", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = {n: F.col(f"_before_{n}") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in sums}
    joined = placed.join(offsets, F.col("_range") == F.col("_at"))
    return joined.withColumns(running).select(*df.columns, *sums)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with its row number from 0 in an order without ties."""
    return with_running(df, order, {name: F.lit(1).cast("long")})


def area_under_roc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """One row: the area under the ROC curve, that is the share of pairs of a positive and a negative row in which the positive
    one has the higher score, equal scores counting half. Null if there is no such pair; rows with a null are left out.

    Rows are counted by score first; the negatives below a score are a running sum over the different scores.
    """
    positive = F.count_if(F.col(label) == 1)
    rows = scores.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(F.col(score).alias("score")).agg(positive.alias("positives"), (F.count("*") - positive).alias("negatives"))
    placed = with_running(counts, [F.col("score").asc()], {"below": F.col("negatives")})
    # twice the won pairs are whole numbers, exact in any order of addition
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    won = F.sum(wide("positives") * (2 * wide("below") + wide("negatives")))
    pairs = F.sum(wide("positives")) * F.sum(wide("negatives"))
    return placed.agg(F.try_divide(won.cast("double"), 2 * pairs.cast("double")).alias("roc_auc"))
