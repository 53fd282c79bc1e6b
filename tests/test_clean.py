import random
import re
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from bazaar.contract import RAW_COLUMNS, TABLES
from bazaar.operators import clean, dedup, outliers

GOOD_LINE = {
    "Invoice ID": "A1", "Line": "1", "Customer ID": "5", "Product ID": "7", "Unit Price": "10.00", "Quantity": "2",
    "Date": "2024-01-02 10:00:00", "Discount": "0.1", "Line Total": "18.00", "Store ID": "3", "Employee ID": "30",
    "Currency": "EUR", "Payment Method": "Cash", "Invoice Total": "18.00",
}


def ids(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_customers(raw):
    rows = raw(
        "customers",
        {"Customer ID": "1", "Name": " Ann ", "Email": " ANN@X.ORG ", "Gender": "null", "Date Of Birth": "1990-05-06"},
        {"Customer ID": "1.0", "Name": "Zoe", "Email": "z@x.org"},
        {"Customer ID": "x", "Name": "nobody"},
        {"Customer ID": None, "Name": "nobody"},
        {"Customer ID": "2", "Email": "  ", "Date Of Birth": "2024-13-01"},
    )
    result = {r.customer_id: r for r in clean.clean("customers", rows).collect()}
    assert set(result) == {1, 2}
    assert (result[1].name, result[1].email, result[1].gender, str(result[1].date_of_birth)) == (
        "Ann", "ann@x.org", None, "1990-05-06",
    )
    assert result[2].email is None and result[2].date_of_birth is None


def test_products(raw):
    cheap = [{"Product ID": str(i), "Production Cost": str(100 + i % 5), "Sizes": "S|M"} for i in range(40)]
    rows = raw(
        "products",
        *cheap,
        {"Product ID": "100", "Production Cost": "NaN"},
        {"Product ID": "101", "Production Cost": "-1"},
        {"Product ID": "102", "Production Cost": "9999"},
        {"Product ID": "", "Production Cost": "100"},
    )
    result = clean.clean("products", rows)
    assert ids(result, "product_id") == [(i,) for i in range(40)]
    assert result.filter("product_id = 0").first().sizes == ["S", "M"]


def test_products_without_any_row(raw):
    assert clean.clean("products", raw("products", {"Product ID": "x"})).count() == 0


def test_stores(raw):
    rows = raw(
        "stores",
        {"Store ID": "1", "Latitude": "10.5", "Longitude": "-180", "Number of Employees": "4"},
        {"Store ID": "2", "Latitude": "91", "Longitude": "0"},
        {"Store ID": "3", "Latitude": "NaN", "Longitude": "0"},
        {"Store ID": "4", "Latitude": "0", "Longitude": "180.1"},
        {"Store ID": "5", "Longitude": "1"},
    )
    assert ids(clean.clean("stores", rows), "store_id", "number_of_employees") == [(1, 4)]


def test_employees(raw):
    rows = raw(
        "employees",
        {"Employee ID": "1", "Store ID": "1"},
        {"Employee ID": "1", "Store ID": "2"},
        {"Employee ID": "2", "Store ID": ""},
        {"Employee ID": "x", "Store ID": "2"},
    )
    assert ids(clean.clean("employees", rows), "employee_id", "store_id") == [(1, 1)]


def test_discounts(raw):
    good = {"Start": "2024-01-01", "End": "2024-01-31", "Discont": "0.2", "Category": "A", "Sub Category": "B"}
    rows = raw(
        "discounts",
        good,
        good,
        good | {"Category": "none"},
        good | {"End": "2023-12-31"},
        good | {"Discont": "1.2"},
        good | {"Discont": ""},
        good | {"Start": "2024-02-31"},
    )
    result = clean.clean("discounts", rows)
    assert ids(result.fillna("-"), "category", "discount") == [("-", Decimal("0.2000")), ("A", Decimal("0.2000"))]


def test_transactions(raw):
    bad = [
        {"Invoice ID": " null "}, {"Customer ID": "x"}, {"Product ID": None}, {"Discount": "1.5"}, {"Discount": ""},
        {"Quantity": "0"}, {"Quantity": "-1"}, {"Quantity": "NULL"}, {"Unit Price": "-0.01"}, {"Unit Price": "NaN"},
        {"Line Total": "-5"}, {"Line Total": None},
    ]
    rows = raw(
        "transactions",
        GOOD_LINE,
        GOOD_LINE | {"Line": "2", "Date": "2024-01-02", "Store ID": None},
        GOOD_LINE | {"Line": None, "Payment Method": " None "},
        *(GOOD_LINE | {"Invoice ID": f"B{i}"} | change for i, change in enumerate(bad)),
    )
    result = clean.clean("transactions", rows).orderBy("line").collect()
    assert [(r.invoice_id, r.line) for r in result] == [("A1", None), ("A1", 1), ("A1", 2)]
    assert result[0].payment_method is None
    assert result[2].date is None and result[2].store_id is None


def test_survivor_does_not_depend_on_order(spark, raw):
    lines = [GOOD_LINE | {"Product ID": str(p), "Color": c} for p in (9, 7, 8) for c in ("red", "blue")]
    for rows in (lines, lines[::-1], lines[3:] + lines[:3]):
        result = clean.clean("transactions", raw("transactions", *rows).repartition(5)).collect()
        assert [(r.product_id, r.color) for r in result] == [(7, "blue")]


def test_dedup_is_idempotent_and_keeps_all_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 37).alias("k"), F.pmod(F.xxhash64("id"), F.lit(11)).alias("v"))
    once = dedup.keep_first(rows, ["k"])
    assert once.count() == 37
    assert ids(dedup.keep_first(once, ["k"]), "k", "v") == ids(once, "k", "v")
    assert ids(once, "k", "v") == ids(rows.groupBy("k").agg(F.min("v").alias("v")), "k", "v")
    assert dedup.duplicated_keys(once, ["k"]).count() == 0
    assert dedup.duplicated_keys(rows, ["k"]).count() == 37


def test_hot_key_is_limited_before_the_shuffle(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    plan = dedup.keep_first(rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("hashpartitioning") < plan.index("Partial")


def test_iqr_bounds_and_nulls(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(1, 101)] + [(1000.0,), (-500.0,), (None,)], "v double")
    low, high = outliers.iqr_bounds(rows, "v", 1.5).first()
    values = sorted(v for (v,) in rows.collect() if v is not None)
    q1, q3 = values[25], values[76]
    assert (low, high) == (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    kept = [r.v for r in outliers.iqr_filter(rows, ["v"]).collect()]
    assert len(kept) == 101 and None in kept and 1000.0 not in kept and -500.0 not in kept


def test_iqr_of_an_empty_column_keeps_all(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2)], "v double, id int")
    assert outliers.iqr_filter(rows, ["v"]).count() == 2


def test_quality_report_adds_up(raw):
    tables = {t: raw(t, {c: None for c in RAW_COLUMNS[t]}) for t in TABLES}
    tables["transactions"] = raw(
        "transactions", GOOD_LINE, GOOD_LINE, GOOD_LINE | {"Quantity": "-1"}, GOOD_LINE | {"Customer ID": "x"}
    )
    report = {r.table_name: r for r in clean.quality_report(tables).collect()}
    assert set(report) == set(TABLES)
    t = report["transactions"]
    assert (t.rows_before, t.rows_after, t.null_id_rows, t.rule_rows, t.duplicate_rows) == (4, 1, 1, 1, 1)
    for r in report.values():
        assert r.rows_dropped == r.null_id_rows + r.rule_rows + r.duplicate_rows + r.outlier_rows


def test_quality_report_agrees_with_cleaning(warehouse):
    rows = {t: warehouse.raw(t) for t in TABLES}
    after = {r.table_name: r.rows_after for r in clean.quality_report(rows).collect()}
    assert after == {t: df.count() for t, df in clean.clean_all(rows).items()}


@pytest.mark.parametrize(("discount", "kept"), [("1", 1), ("1.00004", 0), ("-0.00004", 0), ("0.00004", 1)])
def test_rules_see_unrounded_values(raw, discount, kept):
    assert clean.clean("transactions", raw("transactions", GOOD_LINE | {"Discount": discount})).count() == kept


def test_large_prices_are_kept(raw):
    row = clean.clean("transactions", raw("transactions", GOOD_LINE | {"Unit Price": "123456789012345.5"})).first()
    assert row.unit_price == Decimal("123456789012345.5")


def test_every_rule_drops_something(warehouse):
    for r in clean.quality_report({t: warehouse.raw(t) for t in TABLES}).collect():
        assert r.rows_dropped > 0 and r.duplicate_rows > 0, r


@pytest.mark.parametrize("table", TABLES)
def test_cleaning_is_compiled(spark, warehouse, table):
    """The JVM does not compile methods of 8,000 bytes or more."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = clean.unique_rows(table, warehouse.raw(table))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(plan))]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("factor", [1.5, 3.0])
def test_quartiles_are_exact_beyond_ten_thousand_rows(spark, factor):
    rng = random.Random(9)
    values = sorted(Decimal(rng.randrange(10**7)).scaleb(-2) for _ in range(30_001)) + [Decimal("0.5")] * 4_000
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)] * 7, "v decimal(12,2)")
    values.sort()
    q1, q3 = (float(values[-(-k * len(values) // 4) - 1]) for k in (1, 3))
    assert tuple(outliers.iqr_bounds(rows, "v", factor).first()) == (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
