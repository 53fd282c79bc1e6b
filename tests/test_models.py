import datetime
import math
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from bazaar.plans import churn, features, segments, serving
from bazaar.sources.sinks import write_model
from bazaar.sources.workspace import new_folder


@pytest.fixture(scope="module")
def customer_features(warehouse):
    return warehouse.table("customer_features", lambda: features.customer_features(warehouse.fact()))


@pytest.fixture(scope="module")
def dataset(warehouse):
    return warehouse.table("churn_dataset", lambda: churn.churn_dataset(warehouse.fact()))


@pytest.fixture(scope="module")
def models(dataset):
    return churn.train(dataset)


def lines(spark, *rows):
    schema = (
        "customer_id long, invoice_id string, date timestamp, line_total_usd decimal(18,2), profit_usd decimal(29,2), "
        "quantity int, discount decimal(18,4), promo_active boolean, is_weekend boolean, customer_country string, "
        "customer_gender string, customer_age_at_purchase int"
    )
    made = []
    for customer, invoice, when, revenue, profit in rows:
        made.append(
            (customer, invoice, when and datetime.datetime.fromisoformat(when), revenue and Decimal(revenue),
             profit and Decimal(profit), 1, Decimal("0.1"), None, True, "PT", None, None)
        )
    return spark.createDataFrame(made, schema)


def test_features_of_one_customer(spark):
    rows = features.customer_features(
        lines(spark, (1, "a", "2024-01-10 10:00:00", "10.00", "4.00"), (1, "a", "2024-01-10 10:00:00", "20.00", None),
              (1, "b", "2024-02-01 10:00:00", None, None), (2, "c", "2024-03-01 10:00:00", None, None))
    )
    one, two = rows.orderBy("customer_id").collect()
    assert (one.customer_total_revenue, one.customer_purchase_count, one.customer_average_order_value) == (30.0, 2, 15.0)
    assert (one.customer_total_profit, one.customer_average_profit, one.customer_profit_margin) == (4.0, 4.0, 4 / 30)
    assert (one.customer_promo_purchase_rate, one.customer_weekend_purchase_rate, one.customer_recency_days) == (0, 1, 29)
    # no USD value at all: zeros; unknown age: oldest group although the age is shown as 0
    assert (two.customer_total_revenue, two.customer_average_order_value, two.customer_profit_margin) == (0.0, 0.0, 0.0)
    assert (two.customer_age, two.age_group, two.customer_gender) == (0.0, "55+", None)


def test_features_hash_their_lines(fact):
    plan = features.customer_features(fact)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_one_row_per_customer(customer_features, fact):
    assert customer_features.count() == fact.select("customer_id").distinct().count()


def test_codes_agree_with_the_ranking(customer_features):
    coded = features.with_codes(customer_features)
    index = {(r.column_name, r.value): r["index"] for r in features.category_index(customer_features).collect()}
    for row in coded.collect():
        for column, code in features.CODED_COLUMNS.items():
            assert row[code] == index[column, row[column]]


def test_null_gets_the_code_after_the_last(spark):
    rows = spark.createDataFrame(
        [(1, "A", "F", "18-24"), (2, "B", None, "18-24"), (3, "B", "F", "55+")],
        "customer_id long, customer_country string, customer_gender string, age_group string",
    )
    codes = {r.customer_id: r.customer_gender_index for r in features.with_codes(rows).collect()}
    assert codes == {1: 0.0, 2: 1.0, 3: 0.0}


def test_camel_titles(customer_features):
    names = features.camel_titles(features.with_codes(customer_features)).columns
    assert {"Customer ID", "CustomerTotalRevenue", "AgeGroup", "AgeGroupIndex", "CustomerCountryIndex"} <= set(names)
    assert len(names) == 20


def test_scaling_divides_by_the_standard_deviation(customer_features):
    row = customer_features.agg(F.stddev_samp("customer_recency_days").alias("s")).first()
    scaled = features.scaled(customer_features).select("customer_recency_days", "scaled_features").first()
    assert scaled.scaled_features[-1] == pytest.approx(scaled.customer_recency_days / row.s)


def test_sample_and_split_do_not_depend_on_partitioning(customer_features):
    for choose in (lambda df: features.sample_by_id(df, 0.3), lambda df: features.train_test_split(df).filter("is_train")):
        one, other = (
            {r.customer_id for r in choose(customer_features.repartition(n)).collect()} for n in (1, 7)
        )
        assert one == other and 0 < len(one) < customer_features.count()


def test_segments(customer_features):
    assigned, _, scores = segments.fit_segments(customer_features)
    assert [k for k, _ in scores] == [2, 3, 4, 5, 6]
    assert all(-1 <= s <= 1 for _, s in scores)
    assert assigned.count() == customer_features.count()
    profile = segments.profile(assigned).collect()
    assert len(profile) == segments.best_k(scores)
    assert sum(r.customers for r in profile) == assigned.count()
    again, _, scores_again = segments.fit_segments(customer_features)
    assert scores_again == scores

    def clusters(df):
        return {r.customer_id: r.cluster for r in df.select("customer_id", "cluster").collect()}

    assert clusters(again) == clusters(assigned)


def test_silhouette_equals_the_evaluator(customer_features):
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = features.scaled(customer_features)
    for model in (segments._kmeans(4, 5, "cluster").fit(rows), segments.model_of(rows.sparkSession, [[1.0] * 10, [2.0] * 10])):
        evaluator = ClusteringEvaluator(featuresCol="scaled_features", predictionCol="cluster")
        ours = segments.mean_silhouette(segments.quality(model, rows)).first().silhouette
        assert ours == pytest.approx(evaluator.evaluate(model.transform(rows)), abs=1e-9)


def test_silhouette_by_hand(spark):
    rows = [(0, 0.0, 0.0), (0, 0.0, 2.0), (1, 3.0, 0.0), (1, 3.0, 1.0), (1, 4.0, 0.0), (2, 9.0, 9.0), (1, None, 0.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "cluster int, x double, y double")
    known = [r for r in rows if None not in r]
    square = lambda p, q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    want = {}
    for i, p in enumerate(known):
        mean = {c: [square(p, q) for j, q in enumerate(known) if q[0] == c and j != i] for c in (0, 1, 2)}
        a, b = mean.pop(p[0]), min(sum(d) / len(d) for d in mean.values() if d)
        s = (b - sum(a) / len(a)) / max(b, sum(a) / len(a)) if a else 0
        want.setdefault(p[0], []).append(s)
    got = {r.cluster: (r.customers, r.silhouette) for r in segments.silhouette(df, ["x", "y"]).collect()}
    assert got == {c: (len(s), pytest.approx(sum(s) / len(s))) for c, s in want.items()}
    assert segments.silhouette(df.filter("cluster = 1"), ["x", "y"]).first().silhouette == 0
    assert segments.silhouette(df.limit(0), ["x", "y"]).count() == 0


def test_given_models_are_saved_and_loaded(spark, dataset, customer_features):
    from pyspark.ml.clustering import KMeansModel

    path = new_folder(spark, "given")
    model = churn.model_of(spark, {"customer_recency_days": 0.01}, -1.0)
    write_model(model, path)
    again = churn.load_model(path)
    rows = {r.customer_id: r for r in churn.score(again, dataset).collect()}
    for r in dataset.select("customer_id", "customer_recency_days").collect():
        p = 1 / (1 + math.exp(1 - 0.01 * r.customer_recency_days))
        assert rows[r.customer_id].churn_probability == pytest.approx(p)
    with pytest.raises(ValueError, match="customer_recency_days"):
        churn.score(again, dataset.drop("customer_recency_days"))
    with pytest.raises(ValueError, match="customer_recency_days"):
        churn.score(again, dataset.withColumn("customer_recency_days", F.lit("many")))
    centres = [[0.0] * 10, [3.0] * 10]
    write_model(segments.model_of(spark, centres), f"{path}-segments")
    loaded = KMeansModel.load(f"{path}-segments")
    assert [c.tolist() for c in loaded.clusterCenters()] == centres
    assert {r.cluster for r in segments.assigned(loaded, features.scaled(customer_features)).collect()} == {0, 1}


def test_first_best_k_wins():
    assert segments.best_k([(2, 0.5), (3, 0.7), (4, 0.7)]) == 3


def test_churn_dataset_by_hand(spark):
    rows = lines(
        spark,
        (1, "a", "2024-01-01 10:00:00", "10.00", "5.00"),  # only early: churned
        (2, "b", "2024-01-31 10:00:00", "10.00", None),  # early and late: kept
        (2, "c", "2024-06-01 10:00:00", "99.00", "99.00"),
        (3, "d", "2024-05-01 10:00:00", "10.00", "5.00"),  # only late: no row
        (4, "e", None, "10.00", "5.00"),  # never dated: no row
        (5, "f", "2024-03-03 23:00:00", None, None),  # on the cut-off day: early
    )
    result = {r.customer_id: r for r in churn.churn_dataset(rows).collect()}
    assert {c: r.churn_label for c, r in result.items()} == {1: 1.0, 2: 0.0, 5: 1.0}
    assert (result[2].customer_total_revenue, result[2].customer_total_profit, result[2].customer_purchase_count) == (
        10.0, 0.0, 1,
    )
    assert result[5].customer_recency_days == 0 and result[5].customer_total_revenue == 0.0
    assert result[1].customer_recency_days == 62


def test_churn_model_figures(models):
    assert [m["model"] for m in models.metrics] == ["LogisticRegression", "DecisionTree", "RandomForest"]
    for row in models.metrics:
        assert all(0 <= v <= 1 for k, v in row.items() if k != "model")
    assert models.best_name == max(models.metrics, key=lambda m: m["churn_f1"])["model"]


def test_scores_and_reloaded_model(spark, dataset, models):
    scores = churn.score(models.best, dataset)
    rows = scores.collect()
    assert len(rows) == dataset.count()
    for r in rows:
        level = "HIGH" if r.churn_probability >= 0.8 else "MEDIUM" if r.churn_probability >= 0.5 else "LOW"
        assert 0 <= r.churn_probability <= 1 and r.risk_level == level
    path = new_folder(spark, "model")
    write_model(models.best, path)
    again = churn.score(PipelineModel.load(path), dataset).collect()
    assert {r.customer_id: r.churn_probability for r in again} == {r.customer_id: r.churn_probability for r in rows}


def test_confusion_counts(spark):
    pairs = [(1.0, 1.0)] * 3 + [(0.0, 1.0)] * 1 + [(1.0, 0.0)] * 2 + [(0.0, 0.0)] * 4
    row = churn.confusion_metrics(spark.createDataFrame(pairs, "churn_label double, prediction double")).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (3, 1, 2, 4)
    assert (row.churn_precision, row.churn_recall) == (0.75, 0.6)
    assert row.churn_f1 == pytest.approx(2 * 0.75 * 0.6 / 1.35)
    none = spark.createDataFrame([(0.0, 0.0)], "churn_label double, prediction double")
    assert churn.confusion_metrics(none).first().churn_f1 == 0


def test_all_levels_are_listed(spark):
    schema = "customer_id long, churn_label double, churn_probability double, predicted_churn double, risk_level string"
    scores = spark.createDataFrame([(1, 1.0, 0.9, 1.0, "HIGH"), (2, 0.0, 0.9, 1.0, "HIGH")], schema)
    counts = {(r.kind, r.name): r.customers for r in serving.customer_analytics(scores).collect()}
    assert counts == {
        ("risk_level", "HIGH"): 2, ("risk_level", "MEDIUM"): 0, ("risk_level", "LOW"): 0,
        ("churn_label", "Churned"): 1, ("churn_label", "Not Churned"): 1,
    }
    row = serving.churn_summary(scores).first()
    assert (row.total_customers, row.predicted_churn_customers, row.predicted_churn_rate) == (2, 2, 1.0)
    assert [r.customer_id for r in serving.high_risk_customers(scores, 1).collect()] == [1]
    empty = serving.churn_summary(scores.limit(0)).first()
    assert (empty.total_customers, empty.average_churn_probability, empty.predicted_churn_rate) == (0, 0.0, 0.0)


def test_train_share(dataset):
    counts = Counter(r.is_train for r in features.train_test_split(dataset).collect())
    assert 0.6 < counts[True] / sum(counts.values()) < 0.95
