"""All registered queries by key, each ``(spark, sf_dir) -> DataFrame`` over the star schema in ``sf_dir``.

Results leave with decimals as double and dates as text, so that other engines can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.contract import TABLES, decimals_to_double, to_snake
from bazaar.functions.bands import risk_level
from bazaar.functions.dates import add_date_parts
from bazaar.functions.money import add_usd_columns
from bazaar.functions.sanitize import sanitize_numeric
from bazaar.functions.text import null_placeholders
from bazaar.operators import clean, dedup, fact, outliers, promotions
from bazaar.operators.ranking import area_under_roc
from bazaar.plans import churn, explore, features, kpi, reports, rollup, segments, serving, views
from bazaar.plans.warehouse import DIMENSIONS, Warehouse, open_warehouse
from bazaar.sources import adapter
from bazaar.sources.files import exists, move, remove
from bazaar.sources.raw import read_all_landed, read_csv, read_rejected
from bazaar.sources.sinks import write_csv, write_rows
from bazaar.sources.workspace import bounded_tasks, new_folder
from bazaar.streaming.follow import FactFollower
from bazaar.streaming.land import land_and_wait
from bazaar.streaming.messages import all_messages, from_messages, read_message_files, to_messages

Query = Callable[[SparkSession, str], DataFrame]

LINE_KEY = ("invoice_id", "line")


def plain(df: DataFrame) -> DataFrame:
    df = decimals_to_double(df)
    dated = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c in dated})


# --- ingest ---------------------------------------------------------------------------------------------------------


def _csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    write_csv(adapter.transactions(spark, sf_dir), path)
    return to_snake(read_csv(spark, path, "transactions"))


def _to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_messages(adapter.transactions(spark, sf_dir), "transactions")


def _from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_snake(from_messages(_to_json(spark, sf_dir), "transactions"))


def _topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = all_messages(adapter.raw_tables(spark, sf_dir))
    return messages.groupBy("topic").agg(F.count("*").alias("messages"))


def _landed(spark: SparkSession, messages: DataFrame) -> str:
    """Publish messages to files and land them with a stream; the raw zone's folder."""
    published, raw, checkpoint = (new_folder(spark, name) for name in ("messages", "raw", "stream"))
    write_rows(messages, published)
    land_and_wait(read_message_files(spark, published), raw, checkpoint)
    remove(spark, published)
    return raw


def _land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every landed row of all six topics, its values in the order of the columns joined by bars."""
    landed = read_all_landed(spark, _landed(spark, all_messages(adapter.raw_tables(spark, sf_dir))))
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("~"))
    rows = [landed[t].select(F.lit(t).alias("topic"), F.concat_ws("|", *map(value, landed[t].columns)).alias("row")) for t in TABLES]
    return reduce(DataFrame.unionByName, rows)


def _landed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of customers, and for every nation some that are no JSON object; what was set aside."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    good = to_messages(adapter.customers(spark, sf_dir), "customers")
    wrong = ["%s", '["%s"]', '{"Name":"%s"', '{"Name":"%s"} {"Name":"b"}', '{"Name":"%s"}, {"Name":"b"}', '{"Name":"%s"}xx']
    values = F.explode(F.array(*(F.format_string(w, "n_name") for w in wrong)))
    bad = nations.select(F.lit("customers").alias("topic"), values.alias("value"))
    return read_rejected(spark, _landed(spark, good.unionByName(bad)))


# --- cleaning -------------------------------------------------------------------------------------------------------


def _placeholders(w: Warehouse) -> DataFrame:
    texts = ["color", "payment_method", "currency"]
    rows = null_placeholders(w.raw("transactions"), texts)
    return rows.select(*LINE_KEY, "product_id", "store_id", "line_total", *texts)


def _clean_customers(w: Warehouse) -> DataFrame:
    return clean.clean("customers", w.raw("customers"))


def _clean_products(w: Warehouse) -> DataFrame:
    rows = clean.clean("products", w.raw("products"))
    return rows.select(
        "product_id", "category", "sub_category", "color", "production_cost",
        *(c for c in rows.columns if c.startswith("description_")),
        F.array_join("sizes", "|").alias("sizes"), F.size("sizes").alias("size_count"),
    )


def _clean_stores(w: Warehouse) -> DataFrame:
    return clean.clean("stores", w.raw("stores"))


def _clean_discounts(w: Warehouse) -> DataFrame:
    return clean.clean("discounts", w.raw("discounts"))


def _transactions(w: Warehouse) -> DataFrame:
    return w.clean("transactions")


def _dedup_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return plain(dedup.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]))


def _dedup_full_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line twice, over all its columns; the second one goes."""
    lines = plain(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    return dedup.distinct_rows(lines.unionByName(lines))


def _iqr_filter(w: Warehouse) -> DataFrame:
    rows = clean.unique_rows("products", w.raw("products"))
    return outliers.iqr_filter(rows, ["production_cost"]).select("product_id", "production_cost")


# --- fact -----------------------------------------------------------------------------------------------------------


def _fx_convert(w: Warehouse) -> DataFrame:
    columns = ["currency", "fx_rate_to_usd", "unit_price_usd", "line_total_usd", "invoice_total_usd"]
    return add_usd_columns(_transactions(w)).select(*LINE_KEY, *columns)


def _join_customers(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "customer_id")
    return fact.join_dimension(tx, w.clean("customers"), "customers")


def _join_products(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "product_id")
    return fact.join_dimension(tx, w.clean("products"), "products")


def _join_stores(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "store_id")
    return fact.join_dimension(tx, w.clean("stores"), "stores")


def _join_employees(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "employee_id")
    return fact.join_dimension(tx, w.clean("employees"), "employees")


def _promo_calendar(w: Warehouse) -> DataFrame:
    return promotions.promo_calendar(w.clean("discounts"), w.sales_days()).withColumnRenamed("_purchase_day", "day")


def _lines_with_products(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "date", "product_id")
    return fact.join_dimension(tx, w.clean("products"), "products")


def _promo_columns(df: DataFrame) -> DataFrame:
    return df.select(*LINE_KEY, "promo_discount_pct", "promo_active")


def _promo_join(w: Warehouse) -> DataFrame:
    return _promo_columns(promotions.join_active_promos(_lines_with_products(w), w.calendar()))


def _top1_per_line(w: Warehouse) -> DataFrame:
    days = promotions.promo_days(w.clean("discounts"), w.sales_days())
    return _promo_columns(promotions.best_promo_per_line(_lines_with_products(w), days))


def _customer_age(w: Warehouse) -> DataFrame:
    tx = _transactions(w).select(*LINE_KEY, "customer_id", "date")
    aged = fact.add_customer_age(fact.join_dimension(tx, w.clean("customers"), "customers"))
    return aged.select(*LINE_KEY, "customer_id", "customer_age_at_purchase")


def _profit(w: Warehouse) -> DataFrame:
    tx = fact.join_dimension(add_usd_columns(_transactions(w)), w.clean("products"), "products")
    return fact.add_profit(tx).select(*LINE_KEY, "line_total_usd", "production_cost", "quantity", "profit_usd")


def _date_parts(w: Warehouse) -> DataFrame:
    return add_date_parts(_transactions(w).select(*LINE_KEY, "date"))


def _followed(w: Warehouse) -> FactFollower:
    """A fact whose messages came in two deliveries, copies of a line in either or both."""
    messages = to_messages(adapter.transactions(w.spark, w.sf_dir), "transactions")
    delivery = F.when(F.pmod(F.xxhash64("value"), F.lit(3)) == 0, "second").otherwise("first")
    made, published, out = f"{w.root}/deliveries", f"{w.root}/delivered", f"{w.root}/followed"  # files have the same names in both
    write_rows(messages.withColumn("delivery", delivery), made, by=["delivery"])  # what makes the messages runs once
    follower = FactFollower(w.spark, {t: w.clean(t) for t in DIMENSIONS}, out)
    for part in ("first", "second"):
        if exists(w.spark, f"{made}/delivery={part}"):
            move(w.spark, f"{made}/delivery={part}", f"{published}-{part}")
            follower.follow_and_wait(read_message_files(w.spark, f"{published}-*"), f"{out}/_checkpoint")
            remove(w.spark, f"{published}-{part}")  # a delivery that is in the fact is not read again
    remove(w.spark, made)
    return follower


def _follower(w: Warehouse) -> FactFollower:
    return w.once("followed", lambda: _followed(w))


def _rollup(report: Callable[[DataFrame], DataFrame]) -> Callable[[Warehouse], DataFrame]:
    return lambda w: report(_follower(w).rollup("month_sums"))


def _distinct_sketches(w: Warehouse) -> DataFrame:
    """Exact distinct counts per year, and whether the merged sketches of its months are within four standard errors."""
    guessed = rollup.distinct_counts(_follower(w).rollup("month_sketches"), "purchase_year").toDF("year", *rollup.COUNTED)
    exact = w.fact().groupBy("purchase_year").agg(*(F.count_distinct(c).alias(f"exact_{n}") for n, c in rollup.COUNTED.items()))
    close = {n: F.abs(F.col(n) - F.col(f"exact_{n}")) <= 1 + 4 * rollup.STANDARD_ERROR * F.col(f"exact_{n}") for n in rollup.COUNTED}
    both = exact.join(guessed, F.col("purchase_year").eqNullSafe(F.col("year")))
    return both.select("purchase_year", *(F.col(f"exact_{n}").alias(n) for n in close), *(c.alias(f"{n}_close") for n, c in close.items()))


def _partition_counts(w: Warehouse) -> DataFrame:
    return w.fact().groupBy("purchase_year", "purchase_month").agg(F.count("*").alias("lines"))


def _fact_view(w: Warehouse) -> DataFrame:
    """SQL over the titled view, as existing report queries are written."""
    views.register_fact_view(w.fact())
    return w.spark.sql(
        f"""
        SELECT `Product Category` AS product_category, `Purchase Year` AS purchase_year,
               round(sum(`Line Total USD`), 2) AS revenue_usd, sum(`Quantity`) AS units_sold
        FROM {views.FACT_VIEW} GROUP BY `Product Category`, `Purchase Year`
        """
    )


# --- features and models --------------------------------------------------------------------------------------------


def _features(w: Warehouse) -> DataFrame:
    return w.table("customer_features", lambda: features.customer_features(w.fact()))


def _coded(w: Warehouse) -> DataFrame:
    return features.with_codes(_features(w)).select("customer_id", *features.CODED_COLUMNS.values())


def _validate_duplicates(w: Warehouse) -> DataFrame:
    repeated = dedup.duplicated_keys(_features(w), ["customer_id"])
    return repeated.agg(F.count("*").alias("duplicated_customers"))


def _scaled(w: Warehouse) -> DataFrame:
    values = vector_to_array("scaled_features")
    columns = [F.round(F.get(values, F.lit(i)), 6).alias(c) for i, c in enumerate(features.SEGMENT_FEATURES)]
    return features.scaled(_features(w)).select("customer_id", *columns)


def _segments(w: Warehouse, table: str) -> DataFrame:
    if not w.written(table):
        assigned, _, scores = segments.fit_segments(_features(w))
        w.table("customer_segments", lambda: assigned)
        w.table("segment_k_scores", lambda: w.spark.createDataFrame(scores, "k int, silhouette double"))
    return w.table(table, lambda: None)


def _churn_dataset(w: Warehouse) -> DataFrame:
    return w.table("churn_dataset", lambda: churn.churn_dataset(w.fact()))


def _churn_models(w: Warehouse, table: str) -> DataFrame:
    if not w.written(table):
        models = churn.train(_churn_dataset(w))
        w.table("churn_predictions", lambda: churn.score(models.best, _churn_dataset(w)))
        w.table("churn_model_metrics", lambda: models.metrics_table(w.spark))
    return w.table(table, lambda: None)


def _rule_scores(w: Warehouse) -> DataFrame:
    """Scores by a fixed rule (long absence is risky), so that what follows a score can be checked in SQL."""
    days: Column = F.least("customer_recency_days", F.lit(1000)).cast("double")
    return _churn_dataset(w).select(
        "customer_id",
        churn.LABEL,
        (days / 1000).alias("churn_probability"),
        F.when(days >= 500, 1.0).otherwise(0.0).alias("predicted_churn"),
    ).withColumn("risk_level", risk_level(F.col("churn_probability")))


#: A model without a fit, so that assignment, scores and their figures can be checked in SQL: centres in scaled units, and
#: coefficients of unscaled features.
CENTRES = [[1.0] * 10, [2.0] * 10, [3.0] * 5 + [1.0] * 5]
COEFFICIENTS = {
    "customer_recency_days": 0.004, "customer_purchase_count": -0.05, "customer_promo_purchase_rate": 0.5,
    "customer_profit_margin": -0.75,
}
INTERCEPT = 0.25


def _given_segments(w: Warehouse) -> DataFrame:
    return segments.assigned(segments.model_of(w.spark, CENTRES), features.scaled(_features(w)))


def _given_silhouette(w: Warehouse) -> DataFrame:
    rows = segments.quality(segments.model_of(w.spark, CENTRES), features.scaled(_features(w)))
    return rows.withColumn("silhouette", F.round("silhouette", 6))


def _given_scores(w: Warehouse) -> DataFrame:
    scores = churn.score(churn.model_of(w.spark, COEFFICIENTS, INTERCEPT), _churn_dataset(w))
    return scores.withColumn("churn_probability", F.round("churn_probability", 9))


def _roc_auc(w: Warehouse) -> DataFrame:
    return area_under_roc(_rule_scores(w), churn.LABEL, "churn_probability").select(F.round("roc_auc", 9).alias("roc_auc"))


def _evaluation_metrics(w: Warehouse) -> DataFrame:
    """The figures of a model's report, over the rule's predictions."""
    figures = churn.weighted_metrics(churn.confusion_metrics(_rule_scores(w), prediction="predicted_churn"))
    return figures.select(*(F.round(c, 9).alias(c) for c in ("f1", "weighted_precision", "weighted_recall", "churn_f1")))


def _profile_fixed(w: Warehouse) -> DataFrame:
    """The profile of segments that a rule makes instead of a fitted model."""
    rows = _features(w).withColumn("cluster", (F.col("customer_purchase_count") % 3).cast("int"))
    profile = segments.profile(rows)
    return profile.select("cluster", "customers", *(F.round(c, 6).alias(c) for c in segments.PROFILE))


def _churn_summary(w: Warehouse) -> DataFrame:
    rows = serving.churn_summary(_rule_scores(w))
    return rows.withColumn("average_churn_probability", F.round("average_churn_probability", 9))


def _sanitize(w: Warehouse) -> DataFrame:
    """Roots of losses are NaN, losses are marked -Infinity; neither may reach a client."""
    profit = F.col("profit_usd").cast("double")
    return sanitize_numeric(
        w.fact().select(
            *LINE_KEY,
            "line_total_usd",
            F.sqrt(profit).alias("root_profit"),
            F.when(profit < 0, F.lit(float("-inf"))).otherwise(profit).alias("bounded_profit"),
        )
    )


# --- registry -------------------------------------------------------------------------------------------------------

FROM_FOLDER: dict[str, Query] = {
    "ingest_csv_rows": _csv_rows,
    "ingest_to_json": _to_json,
    "ingest_from_json": _from_json,
    "ingest_topic_counts": _topic_counts,
    "stream_land_raw": _land_raw,
    "raw_landed_rejects": _landed_rejects,
    "dedup_keyed": _dedup_keyed,
    "dedup_full_row": _dedup_full_row,
}

FROM_WAREHOUSE: dict[str, Callable[[Warehouse], DataFrame]] = {
    "null_placeholders": _placeholders,
    "clean_customers": _clean_customers,
    "clean_products": _clean_products,
    "clean_stores": _clean_stores,
    "clean_employees": lambda w: clean.clean("employees", w.raw("employees")),
    "clean_discounts": _clean_discounts,
    "clean_transactions": lambda w: clean.clean("transactions", w.raw("transactions")),
    "clean_quality_report": lambda w: clean.quality_report({t: w.raw(t) for t in TABLES}),
    "iqr_filter": _iqr_filter,
    "fx_convert": _fx_convert,
    "fact_join_customers": _join_customers,
    "fact_join_products": _join_products,
    "fact_join_stores": _join_stores,
    "fact_join_employees": _join_employees,
    "promo_calendar": _promo_calendar,
    "fact_promo_join": _promo_join,
    "top1_per_line": _top1_per_line,
    "customer_age": _customer_age,
    "profit_usd": _profit,
    "date_parts": _date_parts,
    "fact_transactions": lambda w: w.build_fact(),
    "fact_incremental": lambda w: _follower(w).fact(),
    "rollup_sales_profit": _rollup(rollup.sales_profit),
    "rollup_by_year": _rollup(rollup.by_year),
    "rollup_by_month": _rollup(rollup.by_month),
    "rollup_by_category": _rollup(rollup.by_category),
    "rollup_totals": _rollup(rollup.totals),
    "distinct_sketches": _distinct_sketches,
    "fact_partition_counts": _partition_counts,
    "fact_view_sql": _fact_view,
    "customer_features": _features,
    "customer_features_coded": _coded,
    "validate_duplicates": _validate_duplicates,
    "category_index": lambda w: features.category_index(_features(w)),
    "scaled_features": _scaled,
    "customer_segments": lambda w: _segments(w, "customer_segments"),
    "segment_k_scores": lambda w: _segments(w, "segment_k_scores"),
    "segment_profile": lambda w: segments.profile(_segments(w, "customer_segments")),
    "churn_dataset": _churn_dataset,
    "train_test_split": lambda w: features.train_test_split(_churn_dataset(w)).select("customer_id", "is_train"),
    "churn_model_metrics": lambda w: _churn_models(w, "churn_model_metrics"),
    "churn_predictions": lambda w: _churn_models(w, "churn_predictions"),
    "churn_predictions_summary": lambda w: serving.churn_summary(_churn_models(w, "churn_predictions")),
    "risk_band": _rule_scores,
    "evaluation_metrics": _evaluation_metrics,
    "segment_assign": lambda w: _given_segments(w).select("customer_id", "cluster"),
    "silhouette_fixed": _given_silhouette,
    "roc_auc_fixed": _roc_auc,
    "score_fixed": _given_scores,
    "segment_profile_fixed": _profile_fixed,
    "confusion_metrics": lambda w: churn.confusion_metrics(_rule_scores(w), prediction="predicted_churn"),
    "serve_customer_analytics": lambda w: serving.customer_analytics(_rule_scores(w)),
    "serve_churn_summary": _churn_summary,
    "serve_high_risk": lambda w: serving.high_risk_customers(_rule_scores(w)),
    "serve_churn_distribution": lambda w: serving.churn_distribution(_rule_scores(w)),
    "sanitize_numeric": _sanitize,
}

OVER_FACT: dict[str, Callable[[DataFrame], DataFrame]] = {
    "unconverted_currencies": clean.unconverted_currencies,
    "rpt_overview": reports.overview,
    "rpt_sales_profit": reports.sales_profit,
    "rpt_by_year": reports.by_year,
    "rpt_by_month": reports.by_month,
    "rpt_by_category": reports.by_category,
    "rpt_by_subcategory": reports.by_subcategory,
    "rpt_top_products": reports.top_products,
    "rpt_by_customer_country": reports.by_customer_country,
    "rpt_by_store_country": reports.by_store_country,
    "rpt_payment_method": reports.payment_methods,
    "rpt_gender": reports.genders,
    "rpt_weekday_weekend": reports.weekday_weekend,
    "rpt_discount": reports.discounts,
    "rpt_discount_literal": reports.discounts_as_written,
    "rpt_top_customers": reports.top_customers,
    "rpt_top_stores": reports.top_stores,
    "exp_null_counts": explore.null_counts,
    "exp_negative_profit": explore.negative_profit,
    "exp_negative_profit_lines": explore.negative_profit_lines,
    "exp_promo_no_discount": explore.promo_without_discount,
    "exp_overall": explore.overall,
    "exp_store_country": explore.store_countries,
    "exp_payment_method": explore.payment_methods,
    "exp_by_month": explore.months,
    "exp_weekend": explore.weekend,
    "exp_categories": explore.categories,
    "exp_top_subcategories": explore.top_subcategories,
    "exp_margin_by_category": explore.margin_by_category,
    "exp_gender": explore.genders,
    "exp_age_stats": explore.ages,
    "exp_bad_ages": explore.implausible_ages,
    "exp_top_customers": explore.top_customers,
    "exp_top_stores": explore.top_stores,
    "exp_top_employees": explore.top_employees,
    "exp_promo_vs_non": explore.promo_vs_non,
    "exp_promo_distribution": explore.promo_distribution,
    "kpi_executive": kpi.executive,
    "kpi_repeat_customers": kpi.repeat_customers,
    "kpi_stores": kpi.stores,
    "kpi_product": kpi.product,
    "kpi_category_year": kpi.category_year,
    "kpi_year_store": kpi.year_store,
    "kpi_country": kpi.country,
    "kpi_age_group": kpi.age_groups,
    "kpi_filtered": lambda sales: kpi.filtered(sales, year=1997, country="NATION_10"),
    "kpi_drilldown": kpi.drilldown,
    "report_filtered": lambda sales: reports.report(sales.filter(fact.in_period(1997, "Brand#11")), "store_country_sales"),
    "serve_summary": serving.summary,
}


def _from_folder(make: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_tasks(spark)
        return plain(make(spark, sf_dir))

    return query


def _from_warehouse(make: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(make(open_warehouse(spark, sf_dir)))


def _over_fact(make: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: plain(make(open_warehouse(spark, sf_dir).fact()))


def all_queries() -> dict[str, Query]:
    return (
        {key: _from_folder(make) for key, make in FROM_FOLDER.items()}
        | {key: _from_warehouse(make) for key, make in FROM_WAREHOUSE.items()}
        | {key: _over_fact(make) for key, make in OVER_FACT.items()}
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by category straight from the raw tables: clean, convert, join products, profit, report."""
    w = open_warehouse(spark, sf_dir)
    lines = add_usd_columns(clean.clean("transactions", w.raw("transactions")))
    joined = fact.add_profit(fact.join_dimension(lines, clean.clean("products", w.raw("products")), "products"))
    return plain(reports.by_category(joined))
