from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bazaar.contract import snake_name, title_name
from bazaar.functions import bands, dates, money, sanitize, text


def one(spark, expression, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns).select(expression).first()[0]


@pytest.mark.parametrize(
    ("value", "expected"),
    [("12", 12), (" 12 ", 12), ("12.0", 12), ("12.7", 12), ("-3", -3), ("x", None), ("", None), ("NULL", None),
     ("99999999999", None), (None, None), ("1.2.3", None)],
)
def test_to_whole(spark, value, expected):
    assert one(spark, text.to_whole("v"), v=value) == expected


@pytest.mark.parametrize(("value", "expected"), [("\t12", 12), ("12\t", 12), (".5", 0), ("-.5", 0), (" \t-3.9\n", -3), (".", None), ("1 2", None)])
def test_whole_numbers_as_a_cast_reads_them(spark, value, expected):
    assert one(spark, text.to_whole("v"), v=value) == expected


def test_to_id_is_wide(spark):
    assert one(spark, text.to_id("v"), v="99999999999") == 99999999999


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("12.345", "12.345"), ("NaN", None), ("Infinity", None), ("abc", None), ("-1", "-1"), (None, None),
        ("1.00004", "1.00004"), ("-0.00004", "-0.00004"), ("123456789012345.5", "123456789012345.5"), ("1e15", "1e15"),
    ],
)
def test_to_price(spark, value, expected):
    assert one(spark, text.to_price("v"), v=value) == (Decimal(expected) if expected else None)


@pytest.mark.parametrize("value", ["2024-13-01", "01/02/2024", "", None])
def test_bad_days_are_null(spark, value):
    assert one(spark, text.to_day("v"), v=value) is None


def test_instant_needs_a_time(spark):
    assert one(spark, text.to_instant("v"), v="2024-01-02") is None
    assert str(one(spark, text.to_instant("v"), v="2024-01-02 03:04:05")) == "2024-01-02 03:04:05"


@pytest.mark.parametrize(
    ("value", "expected"),
    [(" None ", None), ("nan", None), ("NULL", None), ("  ", None), (" Null x ", "Null x"), ("a", "a"), (None, None)],
)
def test_placeholders(spark, value, expected):
    assert one(spark, text.placeholder_to_null(F.col("v")), v=value) == expected


def test_fx_of_unknown_or_missing_currency_is_null(spark):
    assert one(spark, money.fx_rate(F.col("v")), v="EUR") == Decimal("1.08")
    assert one(spark, money.fx_rate(F.col("v")), v="JPY") is None
    assert one(spark, money.fx_rate(F.col("v")), v=None) is None


def test_usd_is_rounded_half_up(spark):
    rows = spark.sql(
        "SELECT 'EUR' currency, cast(0.125 as decimal(18,4)) unit_price, cast(1.0 as decimal(18,4)) line_total, "
        "cast(null as decimal(18,4)) invoice_total"
    )
    row = money.add_usd_columns(rows).first()
    assert (row.unit_price_usd, row.line_total_usd, row.invoice_total_usd) == (Decimal("0.14"), Decimal("1.08"), None)


def test_mean_rounds_once(spark):
    # mean 1.00499999.., which must not reach 1.01 by way of 1.005
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") < 499_999, F.lit("1.01")).otherwise("1.00").cast("decimal(18,2)").alias("x")
    )
    assert rows.agg(money.mean("x")).first()[0] == 1.00


@pytest.mark.parametrize(
    ("age", "group"),
    [(17.0, "18-24"), (24.9, "18-24"), (25.0, "25-34"), (44.0, "35-44"), (45.0, "45-54"), (55.0, "55+"), (None, "55+")],
)
def test_age_groups(spark, age, group):
    assert one(spark, bands.age_group(F.col("v").cast("double")), v=age) == group


@pytest.mark.parametrize(
    ("p", "level"), [(1.0, "HIGH"), (0.8, "HIGH"), (0.79, "MEDIUM"), (0.5, "MEDIUM"), (0.49, "LOW"), (0.0, "LOW")]
)
def test_risk_levels_cover_all_probabilities(spark, p, level):
    assert one(spark, bands.risk_level(F.col("v")), v=p) == level


@pytest.mark.parametrize(
    ("pct", "fixed", "as_written"),
    [("0.00", "No Discount", "No Discount"), (None, "No Discount", "30%+"), ("0.10", "1-10%", "1-10%"),
     ("0.15", "11-20%", "1-10%"), ("0.30", "21-30%", "1-10%"), ("0.35", "30%+", "1-10%")],
)
def test_discount_ranges(spark, pct, fixed, as_written):
    column = F.col("v").cast("decimal(18,4)")
    assert one(spark, bands.discount_range(column), v=pct) == fixed
    assert one(spark, bands.discount_range_as_written(column), v=pct) == as_written


def test_age_and_calendar_columns(spark):
    rows = spark.sql("SELECT timestamp'2024-03-03 10:00:00' date, date'2000-03-03' date_of_birth")
    row = dates.add_date_parts(rows.withColumn("age", dates.age_at_purchase())).first()
    assert (row.age, row.purchase_day_of_week, row.purchase_month, row.purchase_year, row.is_weekend) == (
        24, 1, 3, 2024, True,
    )
    # one day before the birthday
    rows = spark.sql("SELECT timestamp'2024-03-01 10:00:00' date, date'2000-03-03' date_of_birth")
    assert rows.select(dates.age_at_purchase()).first()[0] == 23


def test_sanitize(spark):
    rows = spark.sql(
        "SELECT double('NaN') a, double('Infinity') b, double('-Infinity') c, 1.5D d, cast(2.5 as decimal(5,2)) e, 7 f, 'x' g"
    )
    assert tuple(sanitize.sanitize_numeric(rows).first()) == (None, None, None, 1.5, 2.5, 7, "x")


@pytest.mark.parametrize(
    ("title", "snake"),
    [("Customer ID", "customer_id"), ("Line Total USD", "line_total_usd"), ("FX Rate To USD", "fx_rate_to_usd"),
     ("Date Of Birth", "date_of_birth"), ("SKU", "sku"), ("Is Weekend", "is_weekend")],
)
def test_names_go_both_ways(title, snake):
    assert (snake_name(title), title_name(snake)) == (snake, title)


def test_misspelt_raw_column():
    assert snake_name("Discont") == "discount"
