import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference
from tests.conftest import SF_DIR

# Model fits: no SQL says what they must return.
ROWS_ONLY = {
    "customer_segments", "segment_k_scores", "segment_profile", "churn_model_metrics", "churn_predictions",
    "churn_predictions_summary",
}
# The text operators have their own tests.
QUERIES = {k: v for k, v in queries().items() if k != "pipeline" and not re.match(r"op\d+_", k)}
ORACLE = {k: v for k, v in oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql_except_model_fits():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"product_category", "revenue_usd", "profit_usd", "units_sold"}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, duck, key):
    assert difference(duck, ORACLE[key], QUERIES[key](spark, SF_DIR)) is None


@pytest.mark.parametrize("key", sorted(ROWS_ONLY))
def test_model_query_has_rows(spark, key):
    assert QUERIES[key](spark, SF_DIR).count() > 0
