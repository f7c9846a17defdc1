"""Keyword headers of sets and images: one table (name, key, value) in text form, with its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("add", "del", "get", "history", "list", "put", "summary")


def mode(text: str) -> str:
    """A mode by its first letters."""
    found = [m for m in MODES if m.startswith(text.lower())]
    if not text or not found:
        raise ValueError(f"{text!r} is no mode")
    return found[0]


def get(header: DataFrame, key: str) -> DataFrame:
    return header.where(F.lower("key") == key.lower()).select("name", "value")


def put(header: DataFrame, key: str, value: str) -> DataFrame:
    """Sets a keyword where it is there; a header without it stays as it is."""
    return header.withColumn("value", F.when(F.lower("key") == key.lower(), F.lit(value)).otherwise(F.col("value")))


def add(header: DataFrame, key: str, value: str) -> DataFrame:
    """Adds a keyword to every header that lacks it."""
    lacks = header.groupBy("name").agg(F.max(F.lower("key") == key.lower()).alias("has")).where("NOT has")
    return header.unionByName(lacks.select("name", F.lit(key).alias("key"), F.lit(value).alias("value")))


def remove(header: DataFrame, key: str) -> DataFrame:
    return header.where(F.lower("key") != key.lower())


def as_columns(header: DataFrame, keys: list[str]) -> DataFrame:
    """One row a header, one column a keyword."""
    return header.groupBy("name").agg(*(F.max(F.when(F.lower("key") == k.lower(), F.col("value"))).alias(k) for k in keys))


def from_columns(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """The keywords of a dimension table: one row a keyword."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys))
    return df.select(F.col(name).cast("string").alias("name"), F.inline(pairs))


def listed_history(history: DataFrame, task: str | None = None) -> DataFrame:
    """The calls of a history, one line each with its parameters in order."""
    h = history if task is None else history.where(F.col("task") == task)
    lines = F.array_sort(F.collect_list(F.concat(F.col("parameter"), F.lit("="), F.col("value"))))
    return h.groupBy("task", "at").agg(F.array_join(lines, ", ").alias("call")).orderBy("at", "task")
