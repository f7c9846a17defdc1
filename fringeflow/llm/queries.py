"""The queries of this subpackage: each operator over its whole table, reduced to its contract's columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_root, table
from . import decontaminate, fingerprint, jaccard_join, licenses, main_text, mixing, quality, sql, token_store, toxicity, url_filter


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_grades(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    token_store.write_store(table(spark, sf_dir, "documents"), path, token_store.default_tokenizer())
    return token_store.read_digests(spark, path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (
        op1_ngram_jaccard_join, op2_ordinal_quality, op3_url_filter, op4_repair_tokens, op5_mixing, op6_toxicity, op7_cws_fingerprints,
        op8_decontamination, op9_main_text, op10_license_scan,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": sql.JACCARD, "op5_mixing": sql.MIXING, "op10_license_scan": licenses.scan_sql()}
