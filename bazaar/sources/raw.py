"""Readers for raw tables: CSV exports and landed JSON lines. All columns are strings under snake_case names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.contract import RAW_COLUMNS, TABLES, to_snake
from bazaar.streaming.messages import from_messages


def read_csv(spark: SparkSession, path: str, table: str, multiline: bool = False) -> DataFrame:
    """A CSV export with a header, as titled string columns; columns are found by name, an empty field is ''.

    A byte order mark is skipped and undecodable bytes become U+FFFD. Files are split among tasks; ``multiline`` allows line
    breaks inside quotes, and then a file is read by one task.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multiline, inferSchema=False)
    rows = rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns})
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in RAW_COLUMNS[table]))


def _landed(spark: SparkSession, root: str, status: str) -> DataFrame:
    """(topic, value) of what landed with a status. Reading the root goes by the sink's log: files of lost tasks are not seen."""
    lines = spark.read.schema("value string, status string, topic string").text(root)
    return lines.filter(F.col("status") == status).select("topic", "value")


def read_landed(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of one topic as landed by ``streaming.land``, all strings; none if the topic had no message."""
    return to_snake(from_messages(_landed(spark, root, "ok"), table))


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """(topic, value) of the messages that are not one JSON object each."""
    return _landed(spark, root, "rejected")


def read_all_landed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {table: read_landed(spark, root, table) for table in TABLES}
