"""The queries opN_<name> of the operators in this folder, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bloomlm, bpe, licenses, neardup, packing, quality, substrings, topk, toxicity, warc
from .runtime import table


def tokenizer() -> str:
    """The vocabulary file; a parameter of the operators, this is the one that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.archive(table(spark, sf_dir, "pages")).select(*names)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_index_merge": warc.ORACLE, "op5_exact_top_k": topk.ORACLE, "op6_quality_rules": quality.ORACLE}
