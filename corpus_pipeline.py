"""The corpus pipeline: documents to token ids, each stage written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm import decontaminate, jaccard_join, mixing, token_store, toxicity
from fringeflow.session import Scratch, scratch_root, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity model, learnt from the labelled ones, does not reject."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of least doc_id, once."""
    return jaccard_join.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.without_passages(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts or leaves out documents so that each source has its target's words."""
    return mixing.expand(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token store and returns one row per document of it."""
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex[:12]}"
    token_store.write_store(docs, path, token_store.default_tokenizer())
    return token_store.read_digests(spark, path)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("tokens", tokens),
]

#: Toxicity and token ids are beyond SQL; tests/llm/test_pipeline.py holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # the store is written
    scratch.drop(docs)
    return out
