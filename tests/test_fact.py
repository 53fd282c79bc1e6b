import datetime
import itertools
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaar.operators import fact as facts
from bazaar.operators.promotions import best_promo_per_line, join_active_promos, promo_calendar, promo_days, sales_days
from bazaar.plans import kpi, reports, serving, views

PROMO_SCHEMA = "category string, sub_category string, start date, end date, discount decimal(18,4)"
LINE_SCHEMA = "invoice_id string, line int, product_category string, product_sub_category string, date timestamp"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(n)


@pytest.fixture(scope="module")
def promo_case(spark):
    rng = random.Random(7)
    promos = []
    for _ in range(60):
        start = rng.randrange(100)
        end = rng.choice([start, start + rng.randrange(30)])
        promos.append((rng.choice("ABC"), rng.choice("XY"), day(start), day(end), rng.choice([0.1, 0.2, 0.3])))
    promos.append(("A", "X", day(90), datetime.date(9999, 12, 31), 0.05))
    promos.append((None, "X", day(0), day(99), 0.9))
    lines = [
        (f"I{i}", i % 3, rng.choice(["A", "B", "D", None]), rng.choice(["X", "Y", None]),
         rng.choice([None, datetime.datetime.combine(day(rng.randrange(120)), datetime.time(23, 59))]))
        for i in range(300)
    ]
    promos = [(*p[:4], Decimal(str(p[4]))) for p in promos]
    expected = {}
    for invoice, line, category, sub, when in lines:
        hits = [p[4] for p in promos
                if when and None not in (category, sub) and p[:2] == (category, sub) and p[2] <= when.date() <= p[3]]
        expected[invoice, line] = max(hits, default=None)
    return spark.createDataFrame(promos, PROMO_SCHEMA), spark.createDataFrame(lines, LINE_SCHEMA), expected


def as_dict(df):
    rows = df.collect()
    result = {(r.invoice_id, r.line): r.promo_discount_pct for r in rows}
    assert len(result) == len(rows)
    assert all(r.promo_active == (r.promo_discount_pct is not None) for r in rows)
    return result


def test_calendar_join_finds_the_best_promotion(promo_case):
    promos, lines, expected = promo_case
    calendar = promo_calendar(promos, sales_days(lines))
    assert as_dict(join_active_promos(lines, calendar)) == expected


def test_ranking_gives_the_same(promo_case):
    promos, lines, expected = promo_case
    assert as_dict(best_promo_per_line(lines, promo_days(promos, sales_days(lines)))) == expected


def test_open_ended_promotion_stays_small(promo_case):
    promos, lines, _ = promo_case
    assert promo_calendar(promos, sales_days(lines)).agg(F.max("_purchase_day")).first()[0] <= day(120)


def test_joins_keep_every_line_once(warehouse, fact):
    assert fact.count() == warehouse.clean("transactions").count()
    assert fact.select("invoice_id", "line").distinct().count() == fact.count()


def test_fact_has_all_columns(fact):
    assert len(fact.columns) == 49


def test_revenue_is_the_same_over_every_grouping(fact):
    total = fact.agg(F.sum("line_total_usd")).first()[0]
    for keys in ("purchase_year", "product_category", "store_country", "customer_gender", "payment_method", "currency"):
        assert fact.groupBy(keys).agg(F.sum("line_total_usd").alias("s")).agg(F.sum("s")).first()[0] == total
    levels = {r.level: r.revenue_usd for r in kpi.drilldown(fact).filter("level = 7").collect()}
    assert levels[7] == float(total)


def test_year_filter_prunes_partitions(fact):
    plan = kpi.filtered(fact, year=1997)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(purchase_year" in plan


def test_reports_scan_only_their_columns(fact):
    plan = reports.by_category(fact)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<(.*?)>\n", plan).group(1)
    assert set(re.findall(r"(\w+):", schema)) == {"product_category", "quantity", "line_total_usd", "profit_usd"}


def test_fifteen_reports_by_name(fact):
    assert len(reports.REPORTS) == 15
    for name, df in reports.all_reports(fact).items():
        assert df.count() > 0, name
    with pytest.raises(KeyError):
        reports.report(fact, "nothing")


def test_approximate_overview(fact):
    exact = reports.overview(fact).first()
    near = reports.overview(fact, F.approx_count_distinct).first()
    for name, value in exact.asDict().items():
        assert near[name] == pytest.approx(value, rel=0.15)


def test_report_row_limit(fact):
    assert reports.report(fact, "monthly_sales", max_rows=3).count() == 3


def test_sql_view_with_titled_names(spark, fact):
    views.register_fact_view(fact, "titled")
    columns = spark.table("titled").columns
    assert {"Customer ID", "FX Rate To USD", "Line Total USD", "Is Weekend", "Customer Age At Purchase"} <= set(columns)
    total = spark.sql("SELECT ROUND(SUM(`Line Total USD`), 2) FROM titled").first()[0]
    assert total == reports.sales_profit(fact).first().total_revenue_usd


def test_hot_customer_is_split_in_the_join(spark):
    """A third of the lines belong to one customer and the tables are too large to broadcast."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(60_000).select(
            F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("customer_id"),
            F.col("id").alias("line"),
            F.sha2(F.col("id").cast("string"), 256).alias("text"),
        ).repartition(16)
        customers = spark.range(60_000).select(
            F.col("id").alias("customer_id"),
            *(F.lit(c).alias(c) for c in ("name", "email", "city", "country", "gender", "job_title")),
            F.lit(None).cast("date").alias("date_of_birth"),
        )
        joined = facts.join_dimension(lines, customers, "customers").select("line", "text", "customer_name")
        rows = joined.collect()
        assert len({r.line for r in rows}) == len(rows) == 60_000
        assert all(r.customer_name == "name" for r in rows)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_period_filters_combine(fact):
    rows = fact.filter(facts.in_period(1997, None, "NATION_10"))
    expected = fact.filter((F.col("purchase_year") == 1997) & (F.col("store_country") == "NATION_10"))
    assert rows.count() == expected.count()
    assert fact.filter(facts.in_period()).count() == fact.count()


def test_group_orders_are_total(fact):
    for make in (reports.top_products, reports.top_customers, reports.top_stores):
        first, again = make(fact).collect(), make(fact.repartition(5)).collect()
        assert first == again
    for a, b in itertools.pairwise(reports.by_store_country(fact).collect()):
        assert (a.revenue_usd or -1) >= (b.revenue_usd or -1)


def test_distinct_counts_do_not_repeat_lines(fact):
    for df in (reports.overview(fact), serving.summary(fact)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
