"""Small file operations through Hadoop's file system, so that they work wherever Spark can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bazaar.sources.workspace import new_folder, shuffles_removed


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _at(spark, path)
    files.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """A file or folder under another name, which nothing has yet."""
    where, files = _at(spark, path)
    if not files.rename(where, _at(spark, to)[0]):
        raise OSError(f"{path} was not moved to {to}")


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    where, files = _at(spark, path)
    return files.getContentSummary(where).getLength()


def mark(spark: SparkSession, path: str) -> None:
    """An empty file."""
    where, files = _at(spark, path)
    files.create(where, True).close()


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to a folder of its own in the shared space and read from there."""
    path = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
