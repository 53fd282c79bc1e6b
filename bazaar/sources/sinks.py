"""Writers. File counts follow data volume: partitions are rebalanced by adaptive execution, never fixed to a number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.ml.util import JavaMLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.sources.workspace import shuffles_removed

FACT_PARTITIONS = ("purchase_year", "purchase_month")
ROWS_PER_FILE = 20_000_000
# A row group is the least that a task can read: with Spark's 128 MB a task gets millions of lines, which it can only spill.
ROW_GROUP_BYTES = 16 << 20
CODEC = "zstd"
# Dictionary of a column in a bucket's file, Spark's being 1 MB. A task fills all buckets side by side, and looks up every value of a row
# in the dictionary of its bucket: those of columns with many values would be in no cache, and pay nothing in files this small.
DICTIONARY_BYTES = 32 << 10
# Files that a task fills side by side; where rows go to more, Spark sorts the rest of the task's rows by file.
OPEN_FILES = 256
SIDE_BY_SIDE = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Writes inside fill the files of their months or buckets side by side, so that a task does not sort its lines first."""
    before = spark.conf.get(SIDE_BY_SIDE)
    spark.conf.set(SIDE_BY_SIDE, str(OPEN_FILES))
    try:
        yield
    finally:
        spark.conf.set(SIDE_BY_SIDE, before)


def gather_months(rows: DataFrame) -> DataFrame:
    """Rows gathered per month so that a month is not scattered over one file per task; a month larger than the advisory
    partition size is split again, so the busiest month is not one task."""
    return rows.hint("rebalance", *(F.col(c) for c in FACT_PARTITIONS))


def write_fact(fact: DataFrame, path: str, only_partitions: bool = False, gathered: bool = False) -> None:
    """Parquet by year and month; with ``only_partitions`` months that have no row here stay as they are.

    Rows that are ``gathered`` per month already are written as their tasks hold them, and so are those of ``only_partitions``,
    which have been staged: a task's rows are in one or few months, and sorting wide lines by them would take more than writing them.
    """
    gathered = gathered or only_partitions
    rows = fact if gathered else gather_months(fact)
    spark = fact.sparkSession
    with shuffles_removed(spark), unsorted_writes(spark) if gathered else nullcontext():
        (
            rows.write.mode("overwrite")
            .option("compression", CODEC)
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .option("partitionOverwriteMode", "dynamic" if only_partitions else "static")
            .partitionBy(*FACT_PARTITIONS)
            .parquet(path)
        )


def write_table(df: DataFrame, path: str) -> None:
    """Features, segments, predictions and other unpartitioned results.

    Rows stay where the last exchange put them; adaptive execution has put its small partitions together.
    """
    write_rows(df, path)


def write_rows(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Rows as their tasks hold them, without a shuffle: for tables as large as the source. ``by`` names columns of few values that
    become folders."""
    spark = df.sparkSession
    with shuffles_removed(spark), unsorted_writes(spark) if by else nullcontext():
        (
            df.write.mode("overwrite")
            .option("compression", CODEC)
            .option("maxRecordsPerFile", ROWS_PER_FILE)
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .partitionBy(*by)
            .parquet(path)
        )


def write_buckets(df: DataFrame, path: str, name: str, key: str, buckets: int) -> DataFrame:
    """df in files by a hash of ``key``, as the table ``name`` of the session's catalog with its files in ``path``.

    Tables in equally many buckets of a key are joined or grouped by it without a shuffle. The rows are in compressed columns, of
    which a line takes a third of what it takes in a shuffle.
    """
    spark = df.sparkSession
    with shuffles_removed(spark), unsorted_writes(spark):
        (
            df.write.mode("overwrite")
            .option("compression", CODEC)
            .option("parquet.block.size", ROW_GROUP_BYTES)
            .option("parquet.dictionary.page.size", DICTIONARY_BYTES)
            .option("path", path)
            .bucketBy(buckets, key)
            .saveAsTable(name, format="parquet")
        )
    return spark.table(name)


def write_model(model: JavaMLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; texts keep their blanks."""
    df.write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
