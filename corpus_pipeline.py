"""A corpus from documents to tokens: STAGES in order, each written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaar.llm import bpe, decontaminate, pii, simhash, toxicity
from bazaar.llm.common import BROADCAST_ROWS, documents, small_batches, table, written
from bazaar.llm.queries import BYTE_RANKS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs whose key is not in the one-column table ``gone``, which is broadcast only if its counted size allows."""
    gone = written(gone.distinct(), "pipeline-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, key, "left_anti")


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject (score below 0.5); null and empty texts stay."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.probability(model)(F.coalesce("text", F.lit(""))) < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate fingerprints: the one with the smallest doc_id.

    Where several rows of a group have that id, or a group has no id at all, one row of it stays, whichever. Null and empty
    texts have one fingerprint and so are one group.
    """
    small_batches(spark)
    marks = written(simhash.near_duplicates(docs, group="__component"), "pipeline-marks")
    repeated = marks.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    plain = _without(docs.where("doc_id is not null"), repeated.union(marks.where("doc_id <> component_id").select("doc_id")), "doc_id")
    odd_ids = written(repeated, "pipeline-repeated")
    odd = docs.join(odd_ids, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))
    odd = odd.withColumn("__fingerprint", simhash.fingerprint_of("text"))
    groups = marks.select(F.col("fingerprint").alias("__fingerprint"), "__component", F.col("component_id").alias("__least")).distinct()
    odd = odd.join(groups, "__fingerprint").where("doc_id = __least or (doc_id is null and __least is null)")
    return plain.select(docs.columns).union(odd.dropDuplicates(["__component"]).select(docs.columns))


def _row_key() -> Column:
    """An id for every row: its doc_id, or a hash of its text where that is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.sha2("text", 256)), F.lit("none"))


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (to 0.8 of its five-word shingles)."""
    small_batches(spark)
    keyed = docs.withColumn("__key", _row_key())
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), key="__key")
    return _without(keyed, found.select("__key"), "__key").select(docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    return pii.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    small_batches(spark)
    return bpe.digests(docs, BYTE_RANKS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("simhash", one_of_each),
    ("decontaminate", not_in_benchmark),
    ("pii", private),
    ("byte_bpe", tokens),
]

#: No SQL expresses trained models, fingerprints of XXH64 or merges by rank.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
