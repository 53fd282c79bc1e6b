"""De-duplication with a survivor that does not depend on partitioning or arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``first``, then by all other columns; nulls sort first.

    Spark limits each key to one row per task before the shuffle, so a key with a large share of the rows does not
    reach one task whole.
    """
    others = [c for c in df.columns if c not in key and c not in first]
    order = [F.col(c).asc_nulls_first() for c in (*first, *others)]
    # a hash in front of the key settles nearly every comparison of the sort, where keys that begin alike would be read in full
    window = Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)
    return df.withColumn("_position", F.row_number().over(window)).filter("_position = 1").drop("_position")


def distinct_rows(df: DataFrame) -> DataFrame:
    """Each row once, over all its columns; nulls are equal to each other."""
    return df.distinct()


def duplicated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")
