import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from bazaar.operators.ranking import area_under_roc, with_position, with_running


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, v long").repartition(6)
    out = with_running(df, [F.desc("k")], {"sum": F.col("v"), "n": F.lit(1)})
    assert out.columns == ["k", "v", "sum", "n"]
    total, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows, reverse=True)):
        want[k] = (total, n)
        total += v
    assert {r.k: (r["sum"], r.n) for r in out.collect()} == want


def test_positions_of_hot_null_and_no_rows(spark):
    rows = [(None, i) for i in range(5)] + [("a", i) for i in range(900)] + [("b", 0)]
    df = spark.createDataFrame(rows, "name string, i long")
    order = [F.col("name").asc_nulls_last(), F.asc("i")]
    out = {(r.name, r.i): r.position for r in with_position(df, order).collect()}
    assert out == {row: n for n, row in enumerate(sorted(rows, key=lambda r: (r[0] is None, r)))}
    assert with_position(df.limit(0), order).count() == 0


def test_ranking_does_not_use_one_task(spark):
    df = spark.range(20_000).withColumn("v", F.hash("id"))
    plan = with_position(df, [F.asc("v"), F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and sum("_range" in w for w in windows) == 1  # the other one is over the sums of the ranges


@pytest.mark.parametrize("levels", [3, 50, 10**9])
def test_area_equals_the_evaluator(spark, levels):
    rng = random.Random(levels)
    rows = [(float(rng.random() < 0.3), rng.randrange(levels) / levels) for _ in range(4000)]
    rows = [(y, min(1.0, s + 0.1 * y)) for y, s in rows]
    df = spark.createDataFrame(rows, "label double, score double")
    exact = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="score", numBins=0).evaluate(df)
    assert area_under_roc(df, "label", "score").first().roc_auc == pytest.approx(exact, abs=1e-12)


def test_area_of_odd_rows(spark):
    area = lambda *rows: area_under_roc(spark.createDataFrame(rows, "label double, score double"), "label", "score").first().roc_auc
    assert area((1.0, 0.5), (1.0, 0.7)) is None and area((None, 0.1), (0.0, None)) is None
    assert area((1.0, 0.5), (0.0, 0.5)) == 0.5 and area((1.0, 0.9), (0.0, 0.1), (None, 0.3), (0.0, None)) == 1.0
