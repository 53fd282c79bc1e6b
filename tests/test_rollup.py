import random

from pyspark.sql import functions as F

from bazaar.plans import reports, rollup, serving


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reports_from_sums(fact):
    sums = rollup.month_sums(fact)
    for ours, full in ((rollup.sales_profit, reports.sales_profit), (rollup.by_year, reports.by_year), (rollup.by_month, reports.by_month), (rollup.by_category, reports.by_category)):
        assert ours(sums).columns == full(fact).columns and rows(ours(sums)) == rows(full(fact))
        period = F.col("purchase_year") == 1996
        assert rows(ours(sums.filter(period))) == rows(full(fact.filter(period)))
    assert rows(rollup.totals(sums)) == rows(serving.summary(fact).select(rollup.totals(sums).columns))
    assert rows(rollup.totals(sums.limit(0))) == [(0, 0.0, 0.0, 0.0)]


def test_no_line_is_read_for_a_report(fact, spark, tmp_path):
    rollup.month_sums(fact).write.parquet(str(tmp_path / "sums"))
    stored = spark.read.parquet(str(tmp_path / "sums"))
    assert stored.count() < fact.count() / 5


def test_sketches_merge_over_any_months(spark):
    """Customers return in other months; the union of sketches is compared with exact counts over random sets of months."""
    lines = spark.range(120_000).select(
        F.lit(2024).alias("purchase_year"), (F.hash("id", F.lit(1)) % 6 + 6).alias("purchase_month"),
        (F.pmod(F.hash("id"), F.lit(20_000))).cast("long").alias("customer_id"), F.concat(F.lit("I"), F.col("id")).alias("invoice_id"),
        F.when(F.col("id") % 10 > 0, F.pmod(F.hash("id", F.lit(2)), F.lit(40))).cast("long").alias("product_id"),
    ).withColumn("purchase_month", F.pmod("purchase_month", F.lit(12)) + 1)
    lines = lines.persist()
    sketches = rollup.month_sketches(lines).persist()
    rng = random.Random(3)
    for n in (1, 2, 5, 12):
        months = F.col("purchase_month").isin(rng.sample(range(1, 13), n))
        exact = lines.filter(months).agg(*(F.count_distinct(c).alias(k) for k, c in rollup.COUNTED.items())).first()
        guess = rollup.distinct_counts(sketches.filter(months)).first()
        for k in rollup.COUNTED:
            assert abs(guess[k] - exact[k]) <= 1 + 4 * rollup.STANDARD_ERROR * exact[k], (n, k)
    assert tuple(rollup.distinct_counts(sketches.limit(0)).first()) in {(0, 0, 0), (None, None, None)}
    lines.unpersist()
    sketches.unpersist()
