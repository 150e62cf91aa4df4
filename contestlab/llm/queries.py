"""Registered queries of the operators: each reads whole tables of the given folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, collocations, credentials, language, minhash, oracles, packing, pieces, private, quality, repeats, rules, search, sharding
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_digests(credentials.secrets(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_near_duplicates": op1_near_duplicates, "op2_personal_data": op2_personal_data, "op3_packing": op3_packing, "op4_suffix_dedup": op4_suffix_dedup, "op5_sharding": op5_sharding, "op6_language_id": op6_language_id, "op7_quality_classifier": op7_quality_classifier, "op8_sentencepiece": op8_sentencepiece, "op9_quality_rules": op9_quality_rules, "op10_top_k": op10_top_k, "op11_filter_audit": op11_filter_audit, "op12_secrets": op12_secrets, "op13_collocations": op13_collocations}


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": oracles.SHARDS, "op9_quality_rules": oracles.quality_rules(), "op10_top_k": oracles.TOP_K, "op11_filter_audit": oracles.FILTER_AUDIT, "op13_collocations": oracles.COLLOCATIONS}
