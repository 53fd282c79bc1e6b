"""The registered queries of the text operators, and their SQL where SQL can say what they return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bazaar.llm import bpe, compact_windows, conversations, decontaminate, fertility, fim, html_crf, minhash, pii, quality, simhash, suffix_dedup, toxicity
from bazaar.llm.common import documents, table

#: Vocabulary files, on every executor.
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), BYTE_RANKS)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.report(documents(spark, sf_dir))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality_rules(documents(spark, sf_dir), PIECES)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(documents(spark, sf_dir))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(table(spark, sf_dir, "conversations"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_crf": op1_html_crf,
    "op2_toxicity": op2_toxicity,
    "op3_pii": op3_pii,
    "op4_decontaminate": op4_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_simhash": op7_simhash,
    "op8_compact_windows": op8_compact_windows,
    "op9_fertility": op9_fertility,
    "op10_quality": op10_quality,
    "op11_fim": op11_fim,
    "op12_conversations": op12_conversations,
    "op13_minhash": op13_minhash,
}
ORACLE: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op11_fim": fim.SQL,
}
