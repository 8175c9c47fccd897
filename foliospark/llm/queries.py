"""The registered queries of the operators, with checking SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (audit, exact, licenses, lines, mil, minhash, mixing, packing, repeats, suffix, syncmers, tokens,
               turns)
from .common import documents


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.contract(documents(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.lm_scores(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(documents(spark, sf_dir))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(spark, f"{sf_dir}/documents.parquet", spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_bytes(documents(spark, sf_dir))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_line_dedup": (op2_line_dedup, lines.SQL),
    "op3_minhash_dedup": (op3_minhash_dedup, None),
    "op4_source_mix": (op4_source_mix, None),
    "op5_exact_dedup": (op5_exact_dedup, exact.SQL),
    "op6_lm_scores": (op6_lm_scores, None),
    "op7_packing": (op7_packing, None),
    "op8_fingerprints": (op8_fingerprints, None),
    "op9_license_scan": (op9_license_scan, None),
    "op10_quality": (op10_quality, None),
    "op11_filter_audit": (op11_filter_audit, audit.SQL),
    "op12_repeated_bytes": (op12_repeated_bytes, repeats.SQL),
    "op13_turn_repair": (op13_turn_repair, None),
}
