"""What the text operators share: tables, written stages, hashes and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.sources.workspace import new_folder

#: Rows up to which a two-column table of numbers may be broadcast (about 16 bytes a row).
BROADCAST_ROWS = 1_000_000
BATCH_ROWS = 1_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Texts are long: Arrow batches of the default 10,000 rows would take tens of MB each, several times over, in the JVM and
    in Python. The setting is the session's, because it holds when a result is computed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and a lost executor costs a re-read.

    The shuffle files behind it go when it is written. By default they stay until the driver's JVM happens to collect what
    refers to them, which may be long after the disks are full.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels nothing may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text) for Python: keys as strings, because pandas would hold numbers with nulls among them as doubles; null texts
    as empty ones."""
    return docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def unkeyed(out: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The key under its name and type again."""
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), *[c for c in out.columns if c != "key"])


def components(links: DataFrame, checkpoint: str = "components") -> DataFrame:
    """(node, component) from links (a, b), both long: component is the smallest node that can be reached.

    Star contraction: every round each node points to the smallest node it knows (large star, then small star), so the
    depth halves, until every node either has one smaller neighbour and no larger one or only larger ones. Rounds are written
    to the shared folder, once each; only a count comes back. A hub's list is never gathered: neighbours meet in a minimum or a
    count, which Spark combines before the shuffle, and in joins, which it can split.
    Nodes without links are not returned. Links of null or equal ends are ignored.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), checkpoint)
    while True:
        both = edges.selectExpr("inline(array(struct(a, b), struct(b as a, a as b)))")
        sides = both.groupBy("a").agg(F.count_if(F.col("b") < F.col("a")).alias("below"), F.count("*").alias("degree"))
        if not sides.where("below > 0 and degree > 1").agg(F.count("*")).first()[0]:
            break
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), checkpoint)
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)


def chunks(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` units together; a longer text is a range of its own."""
    cuts, total = [0], 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            cuts.append(i)
            total = 0
        total += int(n)
    return list(zip(cuts, [*cuts[1:], len(lengths)])) if len(lengths) else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
