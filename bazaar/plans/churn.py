"""Churn: who bought before the last 90 days and not since, three classifiers, scores and risk levels."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaar.functions.bands import risk_level
from bazaar.functions.dates import purchase_day
from bazaar.functions.money import ratio, ratio_or_zero
from bazaar.plans.features import scaler_pipeline, train_test_split

# Observation window, seed, and settings of the three models.
WINDOW_DAYS = 90
SEED = 42
TRAIN_PERCENT = 80
LOGISTIC = {"maxIter": 50, "regParam": 0.01}
TREE = {"maxDepth": 8, "seed": SEED}
FOREST = {"numTrees": 20, "maxDepth": 8, "seed": SEED, "featureSubsetStrategy": "auto"}

LABEL = "churn_label"
FEATURES = (
    "customer_total_revenue", "customer_purchase_count", "customer_total_quantity", "customer_average_order_value",
    "customer_total_profit", "customer_average_profit", "customer_average_discount",
    "customer_promo_purchase_rate", "customer_weekend_purchase_rate", "customer_recency_days",
    "customer_profit_margin",
)


def churn_dataset(fact: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Features from purchases up to the cut-off, label from purchases after it.

    Both come from one grouping: measures look only at earlier lines, the label asks whether there is a later one. That
    replaces a second scan, a distinct and a join of all customers. Customers first seen after the cut-off get no row.
    """
    last_day = fact.agg(F.max(purchase_day())).scalar()
    cutoff = F.date_sub(last_day, window_days)
    dated = fact.filter(F.col("date").isNotNull()).withColumn("_past", purchase_day() <= cutoff)
    past = F.col("_past")

    def earlier(name: str) -> Column:
        return F.when(past, F.col(name))

    def mean(name: str) -> Column:
        return ratio(F.sum(earlier(name)), F.count(earlier(name)))

    sums = (
        dated.groupBy("customer_id")
        .agg(
            F.count_if(past).alias("_lines"),
            F.count_if(~past).alias("_later"),
            F.sum(earlier("line_total_usd")).alias("_revenue"),
            F.count_distinct(earlier("invoice_id")).alias("customer_purchase_count"),
            F.sum(earlier("quantity")).alias("customer_total_quantity"),
            F.sum(earlier("profit_usd")).alias("_profit"),
            mean("profit_usd").alias("customer_average_profit"),
            mean("discount").alias("customer_average_discount"),
            F.count_if(past & F.col("promo_active")).alias("_promo"),
            F.count_if(past & F.col("is_weekend")).alias("_weekend"),
            F.max(F.when(past, purchase_day())).alias("customer_last_purchase_date"),
        )
        .filter("_lines > 0")
    )
    revenue, profit, lines = F.col("_revenue"), F.col("_profit"), F.col("_lines")
    return (
        sums.withColumns(
            {
                "customer_total_revenue": revenue.cast("double"),
                "customer_total_profit": profit.cast("double"),
                "customer_promo_purchase_rate": ratio(F.col("_promo"), lines),
                "customer_weekend_purchase_rate": ratio(F.col("_weekend"), lines),
                "customer_recency_days": F.datediff(cutoff, F.col("customer_last_purchase_date")),
                "customer_average_order_value": ratio(revenue, F.col("customer_purchase_count")),
                "customer_profit_margin": ratio_or_zero(profit, revenue),
                LABEL: F.when(F.col("_later") == 0, 1.0).otherwise(0.0),
            }
        )
        .select("customer_id", *FEATURES, "customer_last_purchase_date", LABEL)
        .fillna(0, list(FEATURES))
    )


def pipelines() -> dict[str, Pipeline]:
    """The candidates, in the order in which ties are decided."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    logistic = LogisticRegression(featuresCol="scaled_features", labelCol=LABEL, **LOGISTIC)
    return {
        "LogisticRegression": Pipeline(stages=[*scaler_pipeline(FEATURES, "keep").getStages(), logistic]),
        "DecisionTree": Pipeline(stages=[assembler, DecisionTreeClassifier(labelCol=LABEL, **TREE)]),
        "RandomForest": Pipeline(stages=[assembler, RandomForestClassifier(labelCol=LABEL, **FOREST)]),
    }


def confusion_metrics(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Counts of the positive class and its precision, recall and F1 (0 where undefined), from one aggregate."""
    actual, said = F.col(label) == 1, F.col(prediction) == 1
    counts = predictions.agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = F.col("churn_precision"), F.col("churn_recall")
    return counts.withColumns(
        {"churn_precision": ratio_or_zero(tp, tp + fp), "churn_recall": ratio_or_zero(tp, tp + fn)}
    ).withColumn("churn_f1", ratio_or_zero(2 * precision * recall, precision + recall))


def weighted_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes, weighted by how often each occurs, from the four counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    figures = []
    for right, wrong, missed in ((tp, fp, fn), (tn, fn, fp)):
        precision, recall = ratio_or_zero(right, right + wrong), ratio_or_zero(right, right + missed)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        figures.append([x * ratio_or_zero(right + missed, total) for x in (f1, precision, recall)])
    names = ("f1", "weighted_precision", "weighted_recall")
    return counts.withColumns({name: a + b for name, a, b in zip(names, *figures)})


def evaluate(predictions: DataFrame) -> dict[str, float]:
    """Area under the ROC curve, weighted F1, precision and recall, and the churn class's own figures."""
    area = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    own = weighted_metrics(confusion_metrics(predictions)).drop("tp", "fp", "fn", "tn").first()
    return {"roc_auc": area.evaluate(predictions), **own.asDict()}


@dataclass(frozen=True)
class ChurnModels:
    metrics: list[dict]
    best_name: str
    best: PipelineModel

    def metrics_table(self, spark: SparkSession) -> DataFrame:
        """One row per candidate."""
        return spark.createDataFrame(self.metrics)


def train(dataset: DataFrame) -> ChurnModels:
    """Fit every candidate on the training part; the one with the highest churn-class F1 on the rest wins.

    The candidates are independent and are fitted side by side.
    """
    rows = train_test_split(dataset, TRAIN_PERCENT).persist(StorageLevel.MEMORY_AND_DISK)
    training, held_out = rows.filter("is_train"), rows.filter("not is_train")

    def fit(candidate: tuple[str, Pipeline]) -> tuple[PipelineModel, dict]:
        name, pipeline = candidate
        model = pipeline.fit(training)
        predictions = model.transform(held_out).select(LABEL, "rawPrediction", "prediction")
        predictions = predictions.persist(StorageLevel.MEMORY_AND_DISK)
        metrics = {"model": name, **evaluate(predictions)}
        predictions.unpersist()
        return model, metrics

    candidates = pipelines()
    with ThreadPoolExecutor(len(candidates)) as pool:
        fitted = list(pool.map(fit, candidates.items()))
    rows.unpersist()
    best, figures = max(fitted, key=lambda pair: pair[1]["churn_f1"])
    return ChurnModels([metrics for _, metrics in fitted], figures["model"], best)


def model_of(spark: SparkSession, coefficients: dict[str, float], intercept: float) -> PipelineModel:
    """A logistic model with given coefficients of unscaled features (0 for the rest), used and saved as a fitted one."""
    values = _py2java(spark.sparkContext, Vectors.dense([coefficients.get(c, 0.0) for c in FEATURES]))
    java = spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("logistic_given", values, float(intercept))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep")
    return PipelineModel([assembler, LogisticRegressionModel(java).setFeaturesCol("features")])


def load_model(path: str) -> PipelineModel:
    """A saved pipeline of this module; anything else is an error here rather than wrong scores later."""
    model = PipelineModel.load(path)
    if not _inputs(model):
        raise ValueError(f"{path} holds no pipeline that assembles its features")
    return model


def _inputs(model: PipelineModel) -> list[str]:
    return [c for stage in model.stages if isinstance(stage, VectorAssembler) for c in stage.getInputCols()]


def check_inputs(model: PipelineModel, dataset: DataFrame) -> None:
    """Every column that the model reads must be there and be a number."""
    kinds = {f.name: f.dataType for f in dataset.schema.fields}
    missing = [c for c in _inputs(model) if c not in kinds]
    other = [c for c in _inputs(model) if c in kinds and not isinstance(kinds[c], (T.NumericType, T.BooleanType))]
    if missing or other:
        raise ValueError(f"the model reads columns that are missing {missing} or no numbers {other}")


def score(model: PipelineModel, dataset: DataFrame) -> DataFrame:
    """Probability and risk level of every customer, training rows included."""
    check_inputs(model, dataset)
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return (
        model.transform(dataset)
        .withColumn("churn_probability", probability)
        .select(
            "customer_id",
            LABEL,
            "churn_probability",
            F.col("prediction").alias("predicted_churn"),
            risk_level(F.col("churn_probability")).alias("risk_level"),
        )
    )
