import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark):
    from bazaar.plans.warehouse import open_warehouse

    return open_warehouse(spark, SF_DIR)


@pytest.fixture(scope="session")
def fact(warehouse):
    return warehouse.fact()


@pytest.fixture
def raw(spark):
    """Raw rows of a table from dictionaries; missing columns are null."""
    from bazaar.contract import RAW_COLUMNS, raw_schema, to_snake

    def make(table, *rows):
        values = [tuple(row.get(c) for c in RAW_COLUMNS[table]) for row in rows]
        return to_snake(spark.createDataFrame(values, raw_schema(table)))

    return make
